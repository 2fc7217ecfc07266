import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.config import EngineConfig
from lectern.operators import catalog, vectors
from lectern.plans import indexing, readonly_sql
from lectern.plans.engine import Engine
from lectern.providers import HashingEmbedder, PlainPages, embed_texts, embedded, embedding
from lectern.sources import corpus
from lectern.sources.store import Store
from lectern.streaming.buffer import history_stream
from lectern.streaming.ingest import index_new_files

# the providers below live in this file, which tasks cannot import
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RIOJA = """## Varietats
La denominació Rioja autoritza la varietat Tempranillo i la varietat Mazuelo en tota la zona de producció, segons el plec de condicions vigent.

## Taules extretes amb IA

### Taula (pàg. 1)

| Vino | Grado alcohólico (% vol) |
|---|---|
| Tinto | mín. 11,5 |
| Tinto | mín. 12 |

### Taula (pàg. 2)
| Variedad | Color |
|---|---|
| Tempranillo | tinta principal |
| Viura | blanca |

### Taula (pàg. 3)
| Municipio | Zona | Provincia |
|---|---|---|
| Haro | Rioja Alta | La Rioja |

### Taula (pàg. 4)
| Vino | Rendimiento kg/ha |
|---|---|
| Tinto joven | 6.500 |
"""
PRIORAT = """## Clima
El Priorat té un clima mediterrani sec, amb sòls de llicorella molt pobres que obliguen les vinyes a arrelar molt endins per trobar aigua, cosa que dona rendiments baixos.

## Taules extretes amb IA
### Taula (pàg. 1)
| Variedad | Color |
|---|---|
| Tempranillo | tinta |
"""
KNOWLEDGE = "## Fermentació\n" + "La fermentació alcohòlica converteix els sucres del most en etanol i diòxid de carboni per acció dels llevats. " * 3


class ScriptedChat:
    """Replies by prompt content; tool calls first if scripted."""

    def __init__(self, rounds=()):
        self.rounds = list(rounds)

    def stream(self, messages, tools=None):
        if tools is not None and self.rounds:
            yield from self.rounds.pop(0)
            return
        text = messages[-1].get("content", "")
        if "subject_type" in text:
            yield {"content": '[{"subject": "rioja", "subject_type": "DOP", "predicate": "AUTHORIZES_VARIETY", "object": "mazuelo", "object_type": "Variety",},]'}
        elif "verdict" in text:
            yield {"content": '[{"claim": "c", "verdict": "SUPPORTED"}]'}
        elif "passage and score" in text:
            yield {"content": '[{"score": 3}]'}
        elif "One integer" in text:
            yield {"content": "4"}
        else:
            yield {"content": "Una "}
            yield {"content": "resposta [1]."}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    for path, text in {
        "Espanya/DOP_Rioja/rioja.pdf": RIOJA, "Espanya/IGP_Priorat__Priorato/priorat.pdf": PRIORAT, "Espanya/altres/x.pdf": "fora",
        "Espanya/DOP_Rioja/nota.txt": "no", "Coneixement/enologia/base/llibre.pdf": KNOWLEDGE,
    }.items():
        target = base / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
    (base / "Espanya/DOP_Rioja/trencat.pdf").write_bytes(b"\xff\xfe\xff")
    return str(base)


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    e = Engine(Store(spark, str(tmp_path_factory.mktemp("store"))), HashingEmbedder(64), ScriptedChat(), PlainPages())
    dry = e.build_index(root, dry_run=True)
    assert dry["extract"] == {"extracted": 3, "skipped": 0, "errors": 0} and dry["ok"] and not e.store.exists("documents")
    first = e.build_index(root)
    assert first["extract"] == {"extracted": 2, "skipped": 0, "errors": 1} and first["ok"] and first["stored"] > 0
    again = e.build_index(root)
    assert again["extract"] == {"extracted": 0, "skipped": 2, "errors": 1} and again["stored"] == first["stored"]
    assert e.build_index(root, V.KNOWLEDGE_COUNTRY)["ok"]
    assert e.build_tables() == {"analytics": 1, "varieties": 3, "yields": 1, "municipalities": 1}
    e.build_graph(chat=e.chat)
    return e


def test_discovery(spark, root):
    found = {(r.folder, r.file) for r in corpus.designation_files(spark, root, "Espanya").select("folder", "file").collect()}
    assert found == {("DOP_Rioja", "rioja.pdf"), ("DOP_Rioja", "trencat.pdf"), ("IGP_Priorat__Priorato", "priorat.pdf")}
    row = corpus.knowledge_files(spark, root).drop("content").first()
    assert (row.category, row.subcategory, row.folder, row.file) == ("enologia", "base", "enologia/base", "llibre.pdf")


def test_parents_fit_chunks(engine):
    missing = engine.store.chunks().filter("parent_id <> ''").join(engine.store.parents().select("parent_id"), "parent_id", "left_anti")
    assert missing.count() == 0 and engine.store.chunks().count() > 0
    knowledge = engine.store.chunks().filter(F.col("country") == V.KNOWLEDGE_COUNTRY).first()
    assert (knowledge.gi_type, knowledge.gi_name, knowledge.subcategory) == ("knowledge", "enologia", "base")


def test_names_and_retrieval(engine):
    assert engine.names_in("varietats de rioja i del priorat") == ["Priorat__Priorato", "Rioja"]
    got = engine.ask("Quina varietat autoritza la DOP Rioja?", top_k=2)
    assert got["ok"] and got["answer"] == "Una resposta [1]." and got["gi_names"] == ["Rioja"]
    assert {c["gi_name"] for c in got["citations"]} == {"Rioja"} and got["citations"][0]["ref"] == "1"
    assert not engine.ask("DOP Inventada?")["ok"]
    assert not engine.ask("hola", country="Portugal")["ok"]


def test_stream(engine):
    tokens, holder = engine.ask_stream("Quin clima té el Priorat?")
    assert list(tokens) == ["Una ", "resposta [1]."] and holder.answer == "Una resposta [1]." and holder.citations
    tokens, holder = engine.ask_stream("DOP Inventada?")
    assert list(tokens) == [holder.answer] == [V.NOTHING_FOUND]


def test_sql(engine):
    rows = engine.sql("SELECT dop, value, relation FROM analytics WHERE parameter LIKE '%ALCOHOL%';")
    assert rows == [{"dop": "Rioja", "value": 11.5, "relation": "min"}]
    assert engine.sql("DROP TABLE analytics")[0]["error"] == "Only SELECT queries are allowed."
    assert "error" in engine.sql("SELECT nope FROM analytics")[0]
    assert len(engine.sql("SELECT id FROM range(200)")) == 50


def test_graph(engine):
    stats = engine.graph_stats()
    assert stats["predicates"]["AUTHORIZES_VARIETY"] > 3 and stats["predicates"]["COAUTHORIZED_WITH"] == 4
    assert stats["predicates"]["SHARES_VARIETY_WITH"] == 1 and stats["predicates"]["ZONE_IN_DOP"] == 1
    text = engine.search_graph("Relació de Haro")
    assert text.startswith(V.GRAPH_TEXT_TITLE) and "- Haro (Municipality) → pertany a la zona → Rioja Alta (Zone)" in text
    assert engine.search_graph("res") == V.GRAPH_EMPTY_MESSAGE
    before = engine.store.read("graph/meta", "schema_version int, built_at timestamp").first().built_at
    engine.build_graph()
    assert engine.store.read("graph/meta", "schema_version int, built_at timestamp").first().built_at == before
    assert not engine.store.graph_is_stale()
    engine.build_graph(designation="rioja", chat=engine.chat)
    assert engine.graph_stats()["predicates"]["COAUTHORIZED_WITH"] == 4


def test_evaluate(engine, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"question": "varietats DOP Rioja?", "ground_truth": "Tempranillo"}, {"question": "DOP Inventada?"}]))
    questions = [r.asDict() for r in corpus.question_set(engine.spark, str(path)).orderBy("ord").collect()]
    assert corpus.question_set(engine.spark, str(path), 1).count() == 1
    questions[1]["question"] = ""
    scores, means = engine.evaluate([questions[0]], engine.chat)
    assert {r.metric: r["mean"] for r in means.collect()} == {
        "faithfulness": 1.0, "answer_relevancy": 0.75, "context_relevancy": 1.0, "ground_truth_accuracy": 0.75}
    assert not scores.first().skipped


def test_page_tables(spark):
    long_page = "x" * 100
    df = spark.createDataFrame([([long_page, "short", long_page], [1, 2, 3], ["| a | b |\n| 1 |", "| a | b |\n| 2 |", "no"])], "p array<string>, t array<int>, r array<string>")
    got = df.select(indexing.tables_section(F.col("p"), F.col("t"), F.col("r"))).first()[0]
    assert got == V.TABLES_SECTION_HEADER + "\n\n\n\n### Taula (pàg. 1)\n\n| a | b |\n| 1 |"


def test_delete_country(spark, engine, root, tmp_path):
    e = Engine(Store(spark, str(tmp_path / "s")))
    e.build_index(root)
    n = e.store.chunks().count()
    assert e.store.reset() == n and e.store.chunks().count() == 0 and e.store.parents().count() == 0


def test_extracted_documents(spark, tmp_path):
    folder = tmp_path / "Espanya" / "DOP_Rioja"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"country": "Espanya", "type": "DOP", "language": "es"}')
    (folder / "a.md").write_text("text a")
    (folder / "b.json").write_text('{"country": "Espanya", "markdown": "text b"}')
    (folder / "c.json").write_text("{broken")
    (folder / "c.md").write_text("text c")
    got = {(r.source_file, r.gi_name, r.language, r.markdown) for r in corpus.extracted_documents(spark, str(tmp_path)).collect()}
    assert got == {("a", "Rioja", "es", "text a"), ("b", "Rioja", "unknown", "text b")}


def test_pending_and_status(spark):
    src = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id int, error string")
    done = spark.createDataFrame([(3,), (3,)], "id int")
    assert {r.id for r in catalog.pending(src, done, ["id"]).collect()} == {1, 2}
    assert {(r.status, r.n) for r in catalog.extraction_status(src, done, ["id"]).collect()} == {("extracted", 1), ("errors", 1), ("skipped", 1)}


@pytest.mark.parametrize("query, error", [
    ("SELECT 1", None), ("select 1;", None), ("WITH a AS (SELECT 1) SELECT * FROM a", None), ("SELECT drop_table FROM a", None),
    ("DELETE FROM a", V.SQL_ERROR_NOT_SELECT), ("SELECT 1; DROP TABLE a", V.SQL_ERROR_MULTI), ("  ", V.SQL_ERROR_EMPTY),
    ("SELECT replace(a) FROM b", "Keyword(s) not allowed: replace."), ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "Keyword(s) not allowed: insert."),
])
def test_guard(spark, query, error):
    assert readonly_sql.check(spark, query) == error


class Failing:
    dim = 4

    def __init__(self, good):
        self.good = good

    def embed(self, texts, kind):
        if self.good <= 0:
            raise OSError("down")
        self.good -= 1
        return HashingEmbedder(4).embed(texts, kind)


def test_embedding_failures():
    cfg, waits = EngineConfig(embedding_batch=2), []
    vectors, error = embed_texts(Failing(1), ["a", "b", "c"], cfg=cfg, sleep=waits.append)
    assert len(vectors) == 2 and "3 times" in error and waits == [1.0, 2.0]
    vectors, error = embed_texts(Failing(1), ["a", "b", "c"], fallback=HashingEmbedder(4), cfg=cfg, sleep=waits.append)
    assert len(vectors) == 3 and error is None


def test_embedding_column(spark):
    df = spark.createDataFrame([("vi negre",), (None,)], "t string").select(embedding("t", HashingEmbedder(8)).alias("v"))
    rows = [r.v for r in df.collect()]
    assert len(rows[0]) == 8 and sum(x * x for x in rows[0]) == pytest.approx(1.0) and sum(rows[1]) == 0
    with pytest.raises(Exception, match="3 times"):
        spark.range(2).select(embedding(F.lit("x"), Broken(8), EngineConfig(embedding_attempts=3))).collect()


class Broken(HashingEmbedder):
    """Fails where a text holds a certain word."""

    def embed(self, texts, kind):
        if any("trenca" in t for t in texts) or "x" in texts:
            raise OSError("down")
        return super().embed(texts, kind)


class Constant:
    dim = 8

    def embed(self, texts, kind):
        return [[2.0] * 8 for _ in texts]


def test_all_vectors_are_of_one_model(spark, monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)
    cfg = EngineConfig(embedding_batch=2, embedding_attempts=1)
    texts = [(k, f"text {k}") for k in range(40)]
    good = spark.createDataFrame(texts, "id int, t string").repartition(4)
    assert (2.0,) * 8 not in {tuple(r.embedding) for r in embedded(good, "t", Broken(8), Constant(), cfg).collect()}
    # one failing batch anywhere, and the fallback embeds every row
    bad = spark.createDataFrame([*texts, (99, "trenca")], "id int, t string").repartition(4)
    rows = embedded(bad, "t", Broken(8), Constant(), cfg).collect()
    assert len(rows) == 41 and {tuple(r.embedding) for r in rows} == {(2.0,) * 8}
    for fallback in (None, Broken(8)):
        with pytest.raises(RuntimeError, match="down"):
            embedded(bad, "t", Broken(8), fallback, cfg)
    assert embedded(bad.limit(0), "t", Broken(8), None, cfg).count() == 0


def test_questions_as_a_table_equal_one_after_another(engine):
    texts = ["varietats DOP Rioja?", "clima del Priorat i de Rioja", "fermentació alcohòlica", "municipis de la DOP Rioja i la DOP Priorat", "", "DOP Inventada?", "fermentació alcohòlica"]
    questions = engine.spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    named = {r.question_id: r.gi_names for r in engine.with_names(questions).collect()}
    assert [named[k] for k in range(len(texts))] == [engine.names_in(t) for t in texts]
    got = {}
    for r in engine.retrieve_all(questions).orderBy("question_id", "ref").collect():
        got.setdefault(r.question_id, []).append((r.ref, r.chunk_id, r.document, round(r.score, 9)))
    for k, t in enumerate(texts):
        want = [(r.ref, r.chunk_id, r.document, round(r.score, 9)) for r in engine.retrieve(t).orderBy("ref").collect()]
        assert got.get(k, []) == want, t
    answers = {r.question_id: r for r in engine.ask_all(questions).collect()}
    for k, t in enumerate(texts):
        one = engine.ask(t)
        assert (answers[k].answer, answers[k].contexts) == (one["answer"], [c["document"] for c in one["context_chunks"]])
    scores, means = engine.evaluate([{"question": t, "ground_truth": "x"} for t in texts], engine.chat)
    assert scores.count() == len(texts) and {r.skipped for r in scores.filter("question = 'DOP Inventada?'").collect()} == {True}


def test_vectors_are_scanned_once_for_all_questions(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 6)).round(1)
    m[100:120], m[7] = m[3], 0
    chunks = spark.createDataFrame([(k, int(k % 3), ["a", "b", None][k % 3 if k < 200 else 2], v.tolist()) for k, v in enumerate(m)] + [(999, 1, "a", None)], "chunk_id long, label int, gi_name string, embedding array<double>").repartition(5)
    asked = [(q, m[q * 7].tolist(), 1 + q % 9, [None, [], ["a"], ["b", "zz"]][q % 4]) for q in range(30)]
    questions = spark.createDataFrame(asked, "question_id long, query array<double>, k int, gi_names array<string>")
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    want = set()
    for q, v, k, names_ in asked:
        for label in range(3):
            near = sorted((round(1 - float(unit(m[i]) @ unit(np.array(v))), 9) + 0.0, i) for i in range(300) if i % 3 == label and (not names_ or (["a", "b", None][i % 3 if i < 200 else 2]) in names_))
            want |= {(q, label, i) for _, i in near[:k]}
    for block in (2048, 7):
        found = vectors.nearest_for_each(chunks, questions, by="label", block=block)
        assert {(r.question_id, r.label, r.chunk_id) for r in found.collect()} == want
    plan = vectors.nearest_for_each(chunks, questions, by="label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert vectors.nearest_for_each(chunks, questions.limit(0), by="label").count() == 0 == vectors.nearest_for_each(chunks.limit(0), questions, by="label").count()


class CountingPages(PlainPages):
    """Leaves a note for every reading of a file."""

    def __init__(self, notes):
        self.notes = notes

    def pages(self, content):
        import os
        import uuid

        with open(os.path.join(self.notes, uuid.uuid4().hex), "wb") as note:
            note.write(content)
        return PlainPages().pages(content)

    def markdown(self, content):
        return PlainPages().markdown(content)


def test_each_pending_file_is_read_once(spark, tmp_path):
    folder, notes = tmp_path / "in/Espanya/DOP_Rioja", tmp_path / "notes"
    folder.mkdir(parents=True), notes.mkdir()
    odd = ["plain.pdf", "strange [1] {a,b} 50%+é.pdf", "star*.pdf", "star2.pdf", "what?.pdf"]
    for k, name in enumerate(odd):
        (folder / name).write_text(f"## Títol\n{RIOJA}\f| número {k} |\n" + "| x | y | z | w |\n" * 9, encoding="utf-8")
    store, cfg = Store(spark, str(tmp_path / "store")), EngineConfig(files_at_once=2)
    run = lambda: indexing.extract(store, str(tmp_path / "in"), "Espanya", CountingPages(str(notes)), chat=ScriptedChat(), cfg=cfg)
    assert run() == {"extracted": len(odd), "skipped": 0, "errors": 0}
    first = len(list(notes.iterdir()))
    assert len({n.read_bytes() for n in notes.iterdir()}) == first == store.documents().count()
    assert run() == {"extracted": 0, "skipped": first, "errors": 0} and len(list(notes.iterdir())) == first
    (folder / "late.pdf").write_text(RIOJA, encoding="utf-8")
    assert run()["extracted"] == 1 and len(list(notes.iterdir())) == first + 1


def test_page_texts_are_not_shuffled(spark, root):
    plan = indexing.extracted(corpus.contents(spark, [f"{root}/Espanya/DOP_Rioja/rioja.pdf"], "Espanya"), PlainPages(), "Espanya", chat=ScriptedChat())
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert "content" not in corpus.listing(spark, root, "Espanya")._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_incremental_stream(spark, root, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    src = tmp_path / "in" / "Espanya" / "DOP_Rioja"
    src.mkdir(parents=True)
    (src / "a.pdf").write_text(RIOJA)
    index_new_files(store, str(tmp_path / "in"), "Espanya", PlainPages(), HashingEmbedder(8)).awaitTermination(120)
    n = store.chunks().count()
    assert n > 0 and store.documents().count() == 1
    (src / "b.pdf").write_text(PRIORAT)
    index_new_files(store, str(tmp_path / "in"), "Espanya", PlainPages(), HashingEmbedder(8)).awaitTermination(120)
    assert store.documents().count() == 2 and store.chunks().count() > n
    assert store.chunks().select("chunk_id").distinct().count() == store.chunks().count()


def test_history_stream(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * (2000 if t == 5 else 3)) for t in range(7)]
    src = str(tmp_path / "talk")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(src)
    q = history_stream(stream, 2).writeStream.format("memory").queryName("talks").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("talks").first()
    assert row.n_messages == 4
    assert row.history.split("\n") == [V.HISTORY_TITLE, "Assistent: xxx", "Usuari: xxx", "Assistent: " + "x" * 1500 + "...", "Usuari: xxx"]


@pytest.mark.parametrize("statement", [
    "SELECT TRANSFORM(x) USING 'cat' AS (y string) FROM t", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM t", "SELECT (SELECT java_method('java.lang.System', 'getProperty', 'user.home'))",
    "SELECT x FROM t WHERE EXISTS (SELECT reflect('java.lang.Math', 'random'))", "SELECT input_file_name() FROM t", "SELECT try_reflect('java.lang.Math', 'random') FROM t",
])
def test_statements_that_run_code_are_refused(spark, statement):
    session = readonly_sql.reader_session(spark, {"t": spark.createDataFrame([("a",)], "x string")})
    assert "error" in readonly_sql.search_tables(session, statement)[0]


@pytest.mark.parametrize("statement", [
    "WITH c AS (SELECT x, count(*) AS n FROM t GROUP BY x) SELECT c.x, n FROM c JOIN t USING (x) ORDER BY n", "SELECT x FROM t WHERE x IN (SELECT upper('a') UNION SELECT x FROM t)",
    "SELECT x, row_number() OVER (ORDER BY x) AS r FROM t LIMIT 3", "SELECT CASE WHEN x LIKE 'A%' THEN 1 END AS y, max(x) OVER () AS m FROM t",
])
def test_relational_statements_are_allowed(spark, statement):
    session = readonly_sql.reader_session(spark, {"t": spark.createDataFrame([("a",)], "x string").filter("x is not null")})
    assert "error" not in readonly_sql.search_tables(session, statement)[0]


def test_limits_of_table_replies_can_be_lifted(spark):
    from dataclasses import replace

    from lectern.config import DEFAULT

    df = spark.createDataFrame([(["x" * 100], [1], ["| a |" + "y" * 9000])], "p array<string>, t array<int>, r array<string>")
    cut, whole = (df.select(F.length(indexing.tables_section(F.col("p"), F.col("t"), F.col("r"), c))).first()[0] for c in (DEFAULT, replace(DEFAULT, table_reply_chars=None)))
    assert cut == 0 and whole > 9000
