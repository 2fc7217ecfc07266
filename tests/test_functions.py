import pytest
from pyspark.sql import functions as F

from lectern.functions import language, names, quantities, replies, text
from lectern.operators import tables


@pytest.mark.parametrize("folder, expected", [
    ("DOP_Rioja", ("DOP", "Rioja", "Rioja", True)),
    ("IGP_Castilla_y_Leon", ("IGP", "Castilla_y_Leon", "Castilla y Leon", True)),
    ("DOP_Priorat__Priorato", ("DOP", "Priorat__Priorato", "Priorat / Priorato", True)),
    ("enologia_base", ("knowledge", "enologia_base", "enologia base", False)),
])
def test_folder_names(value, folder, expected):
    assert tuple(value(folder, names.folder_info)) == expected


def test_unknown_sentinel(value):
    assert value("enologia", lambda c: names.gi_type(c, "unknown")) == "unknown"


def test_ids(value, spark):
    cols = [F.lit("Espanya"), F.lit("DOP_Rioja"), F.lit("DOP_Rioja"), F.lit(3)]
    row = spark.range(1).select(names.chunk_id(*cols), names.parent_id(*cols)).first()
    assert row[0] == "Espanya__DOP_Rioja__DOP_Rioja__3"
    assert row[1] == "Espanya__DOP_Rioja__DOP_Rioja__parent_3"
    assert tuple(value(row[1], names.parse_parent_id)) == ("Espanya", "DOP_Rioja", "DOP_Rioja")
    assert value("a__b", names.parse_parent_id) is None


@pytest.mark.parametrize("path, expected", [
    ("enologia/codex.pdf", ("enologia", "", "enologia")),
    ("regulacio/EU/reg.pdf", ("regulacio", "EU", "regulacio/EU")),
    ("solo.pdf", ("general", "", "general")),
    ("a/b/c/d.pdf", ("a", "b", "a/b/c")),
])
def test_categorize(value, path, expected):
    assert tuple(value(path, names.categorize)) == expected


@pytest.mark.parametrize("question, expected", [
    ("varietats DOP Rioja i DOP Penedès?", ["Rioja", "Penedès"]),
    ("Quin grau té la DOP Rioja?", ["Rioja"]),
    ("hola", []),
    ("la IGP de la Terra Alta, seca", ["Terra_Alta"]),
    ("DOP rioja", []),
    ("DOP Rioja y DOP Rioja", ["Rioja"]),
])
def test_explicit_mentions(value, question, expected):
    assert value(question, names.explicit_mentions) == expected


def test_entity_mentions(value):
    assert value("relació entre Rioja Alta i Mazuelo", names.entity_mentions) == ["Rioja Alta", "Mazuelo", "Rioja", "Alta"]
    assert value("tot en minúscules", names.entity_mentions) == []
    assert value("Quina Època", names.entity_mentions) == ["Quina Època", "Època"]


def test_keywords(value):
    got = value("Quines varietats de Rioja tenen color?", lambda c: names.query_keywords(
        c, F.array(F.lit("Rioja")), ("quines", "tenen"), {"varietat": "variedad", "colorit": "colorido"}))
    assert got == ["varietats", "color", "varietat", "variedad", "colorit", "colorido"]


@pytest.mark.parametrize("raw, expected", [
    ("11,5 % Vol", (11.5, "% Vol", None)), ("mínimo 11,5", (11.5, None, "min")), ("máximo 1.2 g/l", (1.2, "g/l", "max")),
    ("10.000", (10000.0, None, None)), ("10.000 kg/ha", (10000.0, "kg/ha", None)), ("sin dato", (None, None, None)),
    ("1.234.567", (1234.0, None, None)), ("10.500,5", (500.5, None, None)), ("70 hl por hectárea", (70.0, "hl/ha", None)),
    ("5 kg", (5.0, "kg", None)), ("3 gr.", (3.0, "g/l", None)), ("150 mg/l", (150.0, "g/l", None)), ("1.2345", (1.2345, None, None)),
])
def test_quantity(value, raw, expected):
    assert tuple(value(raw, quantities.quantity)) == expected


def test_strict_units(value):
    assert value("150 mg/l", lambda c: quantities.quantity(c, strict=True)).unit == "mg/l"


def test_variety_names(value):
    assert value(" **xarel·lo (blanca)** ", quantities.clean_variety) == "Xarel·Lo"
    assert value("straße d'or", text.title_case) == "Straße D'Or"
    assert value("ßa", text.title_case) == "Ssa"
    assert value("Mazuelo", quantities.is_variety)
    for bad in ("Garnacha Tinta", "12,5", "X", "≥ abc", "a1"):
        assert not value(bad, quantities.is_variety)
    assert value("Dominga", lambda c: quantities.is_variety(c, whole_word=True))
    assert not value("Dominga", quantities.is_variety)


def test_entity_name(value):
    assert value("  rioja   alta ", text.entity_name) == "Rioja Alta"


def test_parameter_and_type(value):
    assert value("Grado alcohólico adquirido", quantities.parameter_key) == "grado_alcoholico"
    assert value("nada", quantities.parameter_key) is None
    assert value("Vino blanco y tinto", quantities.wine_type) == "blanco/tinto"
    assert value("otros", quantities.wine_type) == "general"


def test_clean_markdown(value):
    raw = (
        "BOLETÍN OFICIAL DEL ESTADO Núm. 3\n**==> picture [3 x 4] intentionally omitted <==**\nTítulo\n\n- 5 -\n\n\n\ncos\ncos\n cos\n"
        "Página 7\n**DIRECCIÓN GENERAL DE INDUSTRIAS Y CALIDAD AGROALIMENTARIA**\nfi  "
    )
    assert value(raw, text.clean_markdown) == "Título\n\ncos\n\nfi"
    assert value("BOLETÍN OFICIAL DEL ESTADO", lambda c: text.clean_markdown(c, "")) == "BOLETÍN OFICIAL DEL ESTADO"
    assert value("## Pagina 3\nx", text.clean_markdown) == "## Pagina 3\nx"
    assert value("## Pagina 3\nx", lambda c: text.clean_markdown(c, strip_page_headings=True)) == "x"


def test_text_helpers(value):
    assert value("a" * 9, text.token_estimate) == 2
    assert value("　 x \n", text.strip) == "x"
    assert value("Àbç Ü", text.fold_accents) == "abc u"
    assert value("aaaa", lambda c: text.count_occurrences(c, F.lit("aa"))) == 2
    assert value("x" * 2000, lambda c: text.truncate(c, 1500, "...")) == "x" * 1500 + "..."
    assert value("x", lambda c: text.plain_pages(F.array(c, c))) == "\n\n## Pagina 1\n\nx\n\n\n## Pagina 2\n\nx"


@pytest.mark.parametrize("raw, n", [
    ('[{"subject": "A", "predicate": "P", "object": "B"}]', 1),
    ('```json\n[{"subject": "A", "predicate": "P", "object": "B"}]\n```', 1),
    ('[{"subject": "A", "predicate": "P", "object": "B",},]', 1),
    ('[{subject: "A", predicate: "P", object: "B", attrs: {"x": NaN}}]', 1),
    ('text [\n{"subject": "A", "predicate": "P", "object": "B"}\n{"bad"\n] more', 1),
    ("no list here", 0), ("", 0), ('{"subject": "A"}', 0),
])
def test_triples(value, raw, n):
    assert len(value(raw, replies.parse_triples)) == n


def test_judge_replies(value):
    assert value('```json\n[{"verdict": "SUPPORTED"}, {"verdict": "X"}, 3]\n```', replies.supported_ratio) == pytest.approx(1 / 3)
    for bad in ('{"verdict": "SUPPORTED"}', "nope", "[]", ""):
        assert value(bad, replies.supported_ratio) == 0.0
    assert value('[{"score": 3}, {"score": "2"}, {"score": 2}, 7]', replies.passage_score) == 0.75
    assert value("[]", replies.passage_score) == 0.0
    assert value("score 12, then 4!", replies.scale_score) == 4
    assert value("77", replies.scale_score) is None
    assert value("3", replies.scale_fraction) == 0.5


def test_language(value):
    assert value("The wine of the region is known for the soil", language.detect_language) == "en"
    assert value("xyz", language.detect_language) == "unknown"


def test_pipe_table(value):
    t = value("| A | **B** |\n|---|:-:|\n| 1 | _2_ | 9 |\nnoise\n| | 3 |", tables.parse_table)
    assert t.headers == ["A", "B"] and t.rows == [["1", "2"], ["3", None]]
    t = value("| A | A | C |\n| 1 | 2 | 3 |\n| 4 |", tables.parse_table)
    assert t.headers == ["A", "C"] and t.rows == [["2", "3"], ["4", None]]
    t = value("| A | B | C |\n| 1 |\n| 1 | 2 | *_x_* |", tables.parse_table)
    assert t.headers == ["A"] and t.columns == ["A", "B", "C"] and t.rows == [["1", None, None], ["1", "2", "x"]]
    assert value("| A | B |\n|---|---|", tables.parse_table) is None
    assert value("nothing", tables.parse_table) is None


@pytest.mark.parametrize("headers, kind", [
    (["Variedad", "Color"], "varieties"), (["Vino", "Rendimiento"], "yields"), (["Municipio", "Zona"], "municipalities"),
    (["Grado alcohólico", "x"], "analytics"), (["foo", "bar"], None), (["Aspecto", "Aroma", "Sabor", "Variedad"], None),
])
def test_table_kind(spark, headers, kind):
    h = F.array(*[F.lit(x) for x in headers])
    assert spark.range(1).select(tables.classify_table(h, h)).first()[0] == kind


def test_triples_survive_other_items(value):
    from lectern.functions import replies

    got = value('[1, {"subject":"a","predicate":"p","object":"b"}, "x", null, {"subject":"c"}]', replies.parse_triples)
    assert [(t.subject, t.predicate, t.object) for t in got] == [("a", "p", "b"), ("c", None, None)]
