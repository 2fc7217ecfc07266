"""Fixed values.

Every word list, pattern, label and number in this module has to be exactly what it is for
results to be right: the documents, the stored tables and the graph vocabulary depend on
them.  Nothing here is logic.
"""

# --- collections --------------------------------------------------------------------------
SUPPORTED_COUNTRIES = ("Espanya", "Coneixement")
KNOWLEDGE_COUNTRY = "Coneixement"
DEFAULT_COUNTRY = "Espanya"
GRAPH_SCHEMA_VERSION = 1

METADATA_FIELDS = (
    "folder", "source_file", "country", "gi_type", "gi_name",
    "subcategory", "language", "section", "parent_id",
)

# Characters removed by a Unicode-aware strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- cleaning patterns (d = only \n ends a line, m = multiline, i/u = case folding, U = Unicode classes)
PICTURE_PATTERN = r"(?diu)\*\*==> picture .+? intentionally omitted <==\*\*"
PAGE_NUMBER_PATTERN = r"(?dmU)^\s*-\s*\d+\s*-\s*$"
PAGE_HEADING_PATTERN = r"(?dmU)^#{2,4}\s+[Ppàaág]g[eií]na\s+\d+\s*$"
PAGE_HEADING_PATTERN_FIXED = r"(?dmiuU)^#{2,4}\s+p[aàá]g[eií]na\s+\d+\s*$"
PAGE_WORD_PATTERN = r"(?dmiuU)^\s*(P[àaá]g[eií]na|Pagina|Page|Seite|Pág\.)\s+\d+\s*$"
COUNTRY_HEADER_PATTERNS = {
    "Espanya": (r"(?dmiu)^BOLET[IÍ]N OFICIAL DEL ESTADO.*$",),
}
COUNTRY_HEADER_LITERALS = {
    "Espanya": (
        "**DIRECCIÓN GENERAL DE EMPRESAS AGROALIMENTARIAS Y DESARROLLO RURAL**",
        "**DIRECCIÓN GENERAL DE INDUSTRIAS Y CALIDAD AGROALIMENTARIA**",
    ),
}
PAGE_MARKER_PATTERN = r"(?:pagina?|pàgina?|page|página?)\s+\d+"

# --- sections with tables -----------------------------------------------------------------
TABLES_SECTION_HEADER = "## Taules extretes amb IA"
TABLES_SUBSECTION_PREFIX = "### Taula"

# --- table vocabulary: substring -> (parameter, default unit), first hit wins ---------------
PARAMETERS = (
    ("grado alcohólico", "grado_alcoholico", "% Vol"),
    ("alcohol adquirido", "grado_alcoholico", "% Vol"),
    ("acidez volátil", "acidez_volatil", "g/l"),
    ("acidez total", "acidez_total", "g/l"),
    ("anhídrido sulfuroso", "so2_total", "mg/l"),
    ("sulfuroso total", "so2_total", "mg/l"),
    ("azúcares residuales", "azucares_residuales", "g/l"),
    ("azúcares totales", "azucares_totales", "g/l"),
)
PARAMETER_COLUMN_WORDS = (
    "parámetro", "parametre", "característica", "caracteristica", "paràmetre", "categoria",
)
VALUE_COLUMN_WORDS = ("valor", "value", "unidad", "%", "g/l", "mg/l")
VARIETY_COLUMN_WORDS = (
    "variedad", "variedade", "varietat", "cepa", "uva", "variedades", "varietats",
    "raïm", "raim", "varietats blanques", "varietats negres", "varietats tintes",
)
YIELD_COLUMN_WORDS = (
    "rendimiento", "rendiment", "kg/ha", "hl/ha", "producción", "producció", "kg_ha", "hl_ha",
)
MUNICIPALITY_COLUMN_WORDS = (
    "municipio", "municipi", "provincia", "província", "zona", "parroquia", "pedanía", "pedania",
)
SENSORY_WORDS = (
    "aspecto", "aroma", "sabor", "fase visual", "fase olfativa", "fase gustativa", "limpio",
    "brillante", "turbio", "afrutado", "frutal", "ligeramente ácido", "tacto suave",
    "sin malos olores", "sin presentar aspecto", "notas de envejecimiento",
)
VARIETY_REJECT_WORDS = (
    "blancos", "blancas", "blancs", "blanques", "blanco", "blanca",
    "tintos", "tintas", "tints", "tintes", "tinto", "tinta", "negres",
    "rosados", "rosadas", "rosats", "rosat",
    "grado", "alcohol", "acidez", "azucares", "azúcares", "sulfuroso",
    "anhídrido", "dióxido", "azufre", "máximo", "mínimo", "màxim", "mínim",
    "total", "volátil", "mín", "máx", "min", "max",
    "categoría", "categoria", "parámetro", "parametre", "característica",
    "tipo", "tipus", "clase",
    "aspecto", "aroma", "sabor", "limpio", "brillante", "turbio",
    "afrutado", "frutal", "frutas", "ácido", "ligeramente", "suave", "fresco",
    "color amarillo", "color rojo", "color granate", "sin malos",
    "sin presentar", "notas", "envejecimiento", "olfativa", "gustativa",
    "fase visual", "fase olfativa", "fase gustativa", "visual",
    "intensidad", "calidad", "equilibrio", "estructura", "defectos", "barrica",
    "conservación", "temperatura", "humedad", "capacidad",
)
WINE_TYPES = (
    ("blanco", ("blanco", "blanc", "blanca")),
    ("rosado", ("rosado", "rosat")),
    ("tinto", ("tinto", "negre", "tinta")),
    ("espumoso", ("espumoso", "escumós", "cava")),
    ("generoso", ("generoso", "generós", "licor", "dulce")),
)

# --- names in questions -------------------------------------------------------------------
MENTION_PATTERN = (
    r"(?U)(?:DOP|dop|IGP|igp)\s+(?:de\s+)?(?:la\s+)?(?:el\s+)?"
    r"([A-ZÀ-Ü][\w\s\-']+?)"
    r"(?=\s*(?:[.,?\"']|\s+i\s+|\s+y\s+|\s+o\s+|\s+a\s+|\s+amb\s+|$))"
)
NAME_CONNECTORS = ("de", "del", "dels", "los", "las", "la", "el", "y", "i", "d", "d'")
ENTITY_RUN_PATTERN = r"(?U)\b([A-ZÀ-Ü][a-zà-ü]+(?:\s+[A-ZÀ-Ü][a-zà-ü]+)*)\b"
ENTITY_WORD_PATTERN = r"(?U)\b([A-ZÀ-Ü][a-zà-ü]{2,})\b"
ENTITY_STOP_WORDS = (
    "que", "quines", "quins", "quin", "quina", "com", "per", "amb", "dop", "igp",
    "what", "the", "how", "why", "which", "relacio", "relació", "entre", "sobre",
    "dels", "deles", "segons", "qualsevol", "algun",
)
NODE_MATCH_STOP_WORDS = ("es", "en", "de", "el", "la", "los", "del", "dop")
KEYWORD_PATTERN = r"[a-zA-Zà-üÀ-Ü]{4,}"
ACCENTS_FROM, ACCENTS_TO = "èéàòíúüç", "eeaoiuuc"

# --- sections worth sending to the triple extractor -----------------------------------------
SECTION_KEYWORDS = (
    "variedad", "varietat", "variedades", "varietats", "cepa", "uva", "raïm",
    "municipio", "municipi", "municipios", "municipis",
    "zona", "subzona", "zonas", "subzonas", "comarca",
    "geográf", "geograf", "localidad", "localitat",
    "grado", "alcohol", "graduación", "graduació",
    "acidez", "acidesa", "ácido", "acid",
    "azúcar", "azucar", "azúcares", "azucares",
    "sulfuroso", "anhídrido", "anhidrido", "so2",
    "ph", "parámetro", "parametre",
    "rendimiento", "rendiment", "producción", "producció", "kg/ha", "hl/ha",
    "crianza", "reserva", "envejecimiento", "envelliment", "añada", "anyada",
    "suelo", "sòl", "clima", "climat", "edafolog",
    "altitud", "precipitación", "pluviom", "temperatura",
    "tipo", "tipus", "categoria", "clase",
    "blanco", "blanc", "tinto", "negre", "rosado", "rosat",
    "espumoso", "generoso", "licor",
    "elabor", "producc", "práctica", "practica",
    "vitic", "cultiu", "cultivo", "factores", "factors", "vendimia", "verema",
    "calidad", "qualitat", "característ", "caracterist",
    "organol", "sensorial", "analíti", "analiti", "descripci", "descript",
    "norma", "reglament", "plec", "pliego", "condicion", "condició",
    "denominació", "denominación", "ampar", "nombre", "protegi", "proteg",
    "etiquet", "presentació", "presentación", "consejo", "consell",
    "vinific", "ferment", "macera", "crian", "envejec", "barrica", "botella",
    "prens", "prensa", "filtra",
    "vino", "vinos", "vi", "vins", "producto", "producte",
    "densidad", "densitat", "plantación", "plantacio",
    "marco", "marc", "riego", "regadiu", "reg", "vendim", "verem",
)

# --- graph vocabulary ---------------------------------------------------------------------
PREDICATE_ORDER = (
    "AUTHORIZES_VARIETY", "VARIETY_HAS_COLOR", "COAUTHORIZED_WITH", "SHARES_VARIETY_WITH",
    "MUNICIPALITY_IN_ZONE", "MUNICIPALITY_IN_PROVINCE", "CONTAINS_MUNICIPALITY", "ZONE_IN_DOP",
    "PROVINCE_CONTAINS_DOP", "REQUIRES_PARAMETER", "REGULATES_YIELD", "DEFINES_AGING",
    "HAS_SOIL", "HAS_CLIMATE", "PRODUCES_WINE_TYPE", "SOIL_IN_CLIMATE",
)
PREDICATE_ORDER_OTHER = 50
PREDICATE_LABELS = {
    "AUTHORIZES_VARIETY": "→ autoritza la varietat →",
    "CONTAINS_MUNICIPALITY": "→ conté el municipi →",
    "MUNICIPALITY_IN_ZONE": "→ pertany a la zona →",
    "MUNICIPALITY_IN_PROVINCE": "→ està a la província →",
    "REQUIRES_PARAMETER": "→ requereix el paràmetre →",
    "REGULATES_YIELD": "→ regula el rendiment →",
    "DEFINES_AGING": "→ defineix l'envelliment →",
    "HAS_SOIL": "→ té sòl →",
    "HAS_CLIMATE": "→ té clima →",
    "PRODUCES_WINE_TYPE": "→ produeix el tipus →",
    "VARIETY_HAS_COLOR": "→ és de color →",
    "AGING_APPLIES_TO": "→ aplica a →",
    "PARAMETER_MEASURED_IN": "→ es mesura en →",
    "COAUTHORIZED_WITH": "→ coautoritzada amb →",
    "SOIL_IN_CLIMATE": "→ es troba al clima →",
    "SHARES_VARIETY_WITH": "→ comparteix varietat amb →",
    "ZONE_IN_DOP": "→ està dins de →",
    "PROVINCE_CONTAINS_DOP": "→ conté la DOP →",
}
GRAPH_TEXT_TITLE = "## Coneixements del graf de relacions"
GRAPH_TEXT_OVERFLOW = "- ... i %d relacions més"
GRAPH_EMPTY_MESSAGE = "No relevant relationships found in the knowledge graph."

# --- conversation -------------------------------------------------------------------------
HISTORY_TITLE = "## Historial de la conversa"
USER_LABEL, ASSISTANT_LABEL = "Usuari", "Assistent"
CONTEXT_SEPARATOR = "\n\n---\n\n"

# --- repair of model replies ----------------------------------------------------------------
REPLY_TRAILING_COMMA = r",\s*(\]|\})"
REPLY_TRAILING_COMMA_OF_LINE = r",\s*(\})"
REPLY_BARE_KEY = r"([{,]\s*)([a-zA-Z_][a-zA-Z0-9_]*)\s*:"
REPLY_NOT_A_VALUE = r":\s*(?:undefined|NaN|Infinity|null)\b"
REPLY_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# --- read-only SQL ------------------------------------------------------------------------
BLOCKED_SQL_WORDS = (
    "drop", "delete", "insert", "update", "alter", "create", "attach",
    "detach", "pragma", "replace", "merge", "vacuum", "reindex",
)
SQL_ERROR_EMPTY = "Empty query."
SQL_ERROR_MULTI = "Multi-statement queries (';') are not allowed."
SQL_ERROR_NOT_SELECT = "Only SELECT queries are allowed."
SQL_ERROR_WORDS = "Keyword(s) not allowed: "

# what a user reads when there is no answer
NOTHING_FOUND = "Cap document no respon a aquesta consulta."
NO_QUERY_VECTOR = "La consulta no s'ha pogut convertir en vector: %s"
ANSWER_FAILED = "\n\nNo s'ha pogut acabar la resposta: %s"
