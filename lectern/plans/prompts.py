"""Prompt texts, in our own words."""

SYSTEM = (
    "Respon en l'idioma de la pregunta i només amb el que diuen els documents. "
    "Indica la font de cada afirmació amb el seu número entre claudators."
)
SEVERAL_REGIONS = "\nLa pregunta abasta més d'una denominació: tracta-les per separat i compara-les, si pot ser en una taula."


#: What follows a hint on several regions, the conversation so far, the documents and the question.
ANSWER = (
    "Respon la pregunta amb els documents numerats i cita'ls així: [1]. Si no hi és, digues que no hi és.%s\n\n"
    "%s## Documents\n\n%s\n\n## Pregunta\n\n%s\n\n## Resposta"
)


def answer_prompt(question: str, context: str, n_names: int = 0, history: str = "") -> str:
    return ANSWER % (SEVERAL_REGIONS if n_names > 1 else "", f"{history}\n\n" if history else "", context, question)


TRIPLES = (
    "Llegeix el text i torna només una llista JSON de relacions amb les claus subject, subject_type, predicate, object, "
    "object_type i attrs. Tipus possibles: DOP, IGP, Variety, Municipality, Zone, SoilType, ClimateData, WineType, "
    "AgingCategory, Parameter, ProductionMethod.\n\nText:\n"
)
TABLE = "Torna el contingut tabular d'aquesta pàgina com una sola taula Markdown, sense cap altre text.\n\nPàgina:\n"
FAITHFULNESS = (
    "List the factual claims of the answer as JSON objects with claim and verdict; the verdict is SUPPORTED, CONTRADICTED or "
    "UNVERIFIABLE with regard to the context.\n\nContext:\n%s\n\nAnswer:\n%s\n\nJSON:"
)
ANSWER_RELEVANCY = "From 1 (not at all) to 5 (fully), how well does the answer address the question? One integer.\n\nQuestion: %s\nAnswer: %s"
CONTEXT_RELEVANCY = (
    "Grade the relevance of every passage for the question from 1 to 3. JSON list of objects with passage and score.\n\n"
    "Question: %s\n\nPassages:\n%s\n\nJSON:"
)
GROUND_TRUTH = "From 1 (wrong) to 5 (complete and right), compare the answer with the reference. One integer.\n\nQuestion: %s\nReference: %s\nAnswer: %s"
