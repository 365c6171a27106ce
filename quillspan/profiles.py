"""The two retrieval profiles and their fixed values.

``desktop`` and ``web`` differ in stop words, stemming, folding, chunking,
weights and diversity; they are never mixed.
"""

from __future__ import annotations

from typing import NamedTuple


class Profile(NamedTuple):
    name: str
    stop_words: tuple[str, ...]
    chunk_size: int
    chunk_overlap: int
    top_k: int
    per_source: int
    least_score: float


# Stop words of the desktop profile.
DESKTOP_STOP_WORDS = tuple(
    """ahi algo ante aqui cada como con cual cuando desde donde dos el ella ellas ellos en entre era ese eso esta este estos
    hay la las los mas muy para pero por que sin sobre son sus tambien todo una uno unos""".split()
)
# Stop words of the web profile.
WEB_STOP_WORDS = tuple(
    """a al algo ante como con cuando cual de del donde el ella ellas ellos en entre era ese eso esta este fue ha hay la las
    lo los mas momento para pero por que quien quienes se sin sobre son su sus un una y""".split()
)
# Endings that the web profile cuts, the first that fits.
WEB_ENDINGS = tuple("amientos imientos aciones adores adoras idades mente acion imiento adora ador idad icos icas ismo istas".split())

DESKTOP = Profile("desktop", DESKTOP_STOP_WORDS, 1100, 220, 8, 3, 0.32)
WEB = Profile("web", WEB_STOP_WORDS, 1050, 180, 12, 2, 0.08)

# Phrases of low signal.
LOW_SIGNAL_PHRASES = (
    "adoptar la tecnica de estudio",
    "desarrollar tecnica de estudio",
    "estudio de practica basado",
    "incorporar el estudio basado",
    "participar en actividades que promuevan",
)

# What a question asks for, and what answers a question about a change.
DESKTOP_ASKS = {
    "date": ("cuando", "fecha", "momento", "ano"),
    "person": ("quien", "quienes", "persona", "autor"),
    "change": ("saco", "retiro", "elimino", "acepto", "cambio", "dejo"),
}
DESKTOP_CHANGES = ("suprim", "retir", "elimin", "acept", "reemplaz", "dejo de", "cambio")
WEB_ASKS = {
    "date": ("cuando", "fecha", "momento", "año", "ano"),
    "person": ("quien", "quienes", "persona", "autor", "impulso"),
    "change": ("acepto", "cambio", "dejo", "elimino", "retiro", "saco", "suprimio"),
}
WEB_CHANGES = ("acept", "cambi", "dejo de", "elimin", "reemplaz", "retir", "suprim")

# Patterns of dates and names. In those of the web profile a word's edge is that of ASCII words, spelt out with what stands before and after.
YEAR = r"(?:18|19|20)\d{2}"
DESKTOP_DATE = rf"(?i)(?U)\b\d{{1,2}}\s+de\s+[a-záéíóúñ]+\s+de\s+{YEAR}\b"
WEB_DATE = rf"(?<![0-9A-Za-z_])\d{{1,2}}\s+de\s+\p{{L}}+\s+de\s+{YEAR}(?![0-9A-Za-z_])"
WEB_DATE_PRECISE = rf"(?<![0-9A-Za-z_])\d{{1,2}}\s+(?:y\s+\d{{1,2}}\s+)?de\s+\p{{L}}+\s+de\s+{YEAR}(?![0-9A-Za-z_])"
WEB_YEAR = rf"(?<![0-9A-Za-z_]){YEAR}(?![0-9A-Za-z_])"
DESKTOP_PERSON = r"(?U)\b[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)+\b"
#: An ASCII word boundary, as web text functions have it, before or after any letter.
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
WEB_PERSON = _EDGE + r"\p{Lu}\p{Ll}+(?:\s+(?:[A-Z]\.\s+)?\p{Lu}\p{Ll}+)+" + _EDGE

# Words and labels of concept questions.
CONCEPT_FILLERS = ("concepto", "definicion", "sobre", "acerca", "segun", "fuentes", "drive")
CONCEPT_ALIASES = {
    "territori": "territorio",
    "territor": "territorio",
    "territorialida": "territorialidad",
    "subjetivida": "subjetividad",
    "intervencion": "intervencion",
    "intervencione": "intervencion",
    "comunitari": "comunitario",
}
CONCEPT_PATTERNS = (
    r"^(?:que es|que significa|defini|definicion de|concepto de|explica|explicame|desarrolla)\s+(.+)$",
    r"^(?:el concepto de|la idea de|nocion de)\s+(.+)$",
)
CONCEPT_VARIANTS = {
    "territorio": ("territorial", "territorialidad", "territorios", "espacio social", "barrio", "actores territoriales", "organizacion comunitaria"),
    "construccion de la demanda": (
        "demanda barrial", "demandas identificadas", "demandas circulan", "enunciar demandas",
        "actores logran enunciar demandas", "necesidades del territorio", "problema de intervencion", "intervencion comunitaria",
    ),
}
CONCEPT_THEMES = {
    "territorio": (
        ("espacio social y material", ("espacio", "barrio", "zona", "sector", "ruta", "cuenca")),
        ("historia y procesos de construcción", ("historia", "historico", "origen", "autoconstruccion", "prolongada")),
        ("actores y organización comunitaria", ("actores", "vecinal", "comunitaria", "referentes", "organizacion", "comision")),
        ("demandas y condiciones de vida", ("demandas", "infraestructura", "vulnerabilidad", "carencias", "necesidades")),
        ("intervenciones e instituciones", ("intervenciones", "institucionales", "programas", "estado", "servicios", "caif")),
        ("diferencias internas", ("homogeneo", "diferenciacion", "norte", "sur", "distincion", "heterogeneo")),
    ),
    "construccion de la demanda": (
        ("necesidades que se vuelven formulables", ("demanda", "demandas", "necesidades", "problema")),
        ("actores que logran enunciarla", ("actores", "vecinos", "referentes", "comision", "comunitaria")),
        ("condiciones territoriales que la orientan", ("territorio", "barrio", "infraestructura", "vulnerabilidad")),
        ("intervencion posible", ("intervencion", "linea", "trabajo", "recursos", "institucional")),
    ),
    "demanda": (
        ("necesidad, pedido o reclamo formulado", ("demanda", "demandas", "necesidad", "pedido", "reclamo")),
        ("actores que pueden enunciarla", ("actores", "vecinos", "referentes", "sujeto", "comunidad")),
        ("condiciones institucionales que la vuelven atendible", ("institucionales", "intervencion", "programa", "servicios")),
        ("uso económico del término", ("mercado", "consumo", "precios", "existencias", "produccion")),
    ),
}
GENERAL_THEMES = (
    ("definiciones y usos explícitos del término", ()),
    ("relaciones con otros conceptos", ("relacion", "articula", "vincula", "asocia")),
    ("rasgos o dimensiones mencionadas", ("dimensiones", "rasgos", "caracteristicas", "elementos")),
)

# Sentences of composed answers.
EXTRACTIVE_HEAD = "Con lo que aparece en tus materiales locales, las pistas más fuertes son:"
EXTRACTIVE_TAIL = "La lectura conviene hacerla cruzando esas fuentes, porque el índice encontró coincidencias en más de un documento."
NOTHING_FOUND = "No encontré evidencia fuerte en el índice local para responder. Probá con otros términos o actualizá el índice si agregaste archivos nuevos."
CONCEPT_REQUEST = (
    "Defini conceptualmente '{concept}' usando solo las fuentes locales. No te limites a decir donde aparece: explica que significa, sus rasgos, "
    "matices y una definicion de trabajo con citas. Consulta original: {query}"
)
CAVEAT_EMPTY = "No apareció evidencia suficiente. Probá otra formulación o agregá más material a la base."
CAVEAT = "La respuesta es extractiva: muestra lo que la base realmente dice y no completa huecos con información inventada."
NOTICE_BLANK = "Escribí una idea, palabra o pregunta para buscar."
NOTICE_WORDS = "La búsqueda se resolvió por palabras. Activá “Preparar ideas” para sumar similitud conceptual sin enviar tus textos."
NOTICE_FAILED = "No pude usar el motor conceptual; mostré coincidencias por palabras."
REASON_DATE, REASON_PERSON = "fecha o momento", "persona o actor mencionado"
REASON_CONCEPT, REASON_PASSAGE = "coincidencia conceptual", "pasaje relevante"
MODES = ("sin resultados", "modelo local", "concepto local con fuentes", "síntesis local extractiva")
STATUS_INDEXED, STATUS_EMPTY = "indexado", "sin_texto_extraible"
EXTENSIONS = (".pdf", ".docx", ".txt", ".md", ".rtf")
