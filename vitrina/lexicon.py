"""Lexicons and matcher profiles.

A profile is a row of settings: which words are ignored, how tokens are
rewritten, what similarity is enough, how ties fall.  The matching operators
read a profile; none of them branches on a brand name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


# ---------------------------------------------------------------------------
# Patterns that decide which keys and words a title has.
# ---------------------------------------------------------------------------
LINE_PREFIX = r"(?i)^(?:FARMINA\s+)?(?:N(?:&|AND)D\s+|ND\s+|VET\s+LIFE\s+|VETLIFE\s+)"
WEIGHT_PATTERN = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:kg|g|gr|lb)\b"
NOISE_PAREN = r"(?i)\s*\((?:NDR|PV|NV|ONLINE)\)\s*"
NOISE_FULL = r"(?i)\s*(?:\*[^*]*\*|\((?:NDR|PV|NV|ONLINE)\))\s*"
SIZE_PATTERN = (
    r"\b\d+\s*[x×]\s*\d+[\.,]?\d*\s*(?:kg|g|gr|lb|lbs|ml|l)\b"
    r"|\b\d+\s*[x×]\s*\d+\b"
    r"|\b\d+[\.,]?\d*\s*(?:kg|g|gr|lb|lbs|ml|l)\b"
    r"|\b\d+\s*uds?\b"
    r"|\b(?:individual|l|m|s|xl|xxl)\b"
)
VENDOR_PREFIX = r"^(?:alpha\s+spirit\s+|alpha\s+the\s+|alpha\s+)"
PACK_PATTERN = r"\d+[x×]\d+\w*"
AMOUNT_PATTERN = r"\d+[\.,]?\d*\s*(?:kg|g|gr|l|ml|tab|und)\b"
PARENS_PATTERN = r"\(.*?\)"

# ---------------------------------------------------------------------------
# Ignored words per profile.
# ---------------------------------------------------------------------------
STOP_ACANA = (
    "acana", "eu", "aca", "new", "emea", "apac", "para", "de", "el", "la", "los", "las", "con", "sin", "kg",
    "gr", "g", "lb", "x", "adult", "adulto", "adultos",
)
STOP_ACANA_LEGACY = STOP_ACANA + ("cat", "dog", "feline", "canine")
STOP_AFFINITY = (
    "affinity", "advance", "libra", "brekkies", "naturaltrainer", "natural", "trainer", "natures", "variety",
    "nature", "ndr", "pv", "nv", "online", "de", "el", "la", "los", "las", "con", "sin", "y", "kg", "gr", "g",
    "lb", "x", "ml", "a", "e", "o",
)
STOP_CALIBRA = (
    "calibra", "de", "el", "la", "los", "las", "con", "sin", "y", "para", "kg", "gr", "g", "lb", "x", "ml",
    "new",
)
STOP_FARMINA = (
    "farmina", "nd", "vet", "life", "vetlife", "de", "el", "la", "los", "las", "con", "sin", "y", "para", "e",
    "o", "al", "un", "una", "a", "kg", "g", "gr", "lb", "ml", "l", "x",
)
STOP_APPLAWS = (
    "applaws", "de", "el", "la", "los", "las", "con", "sin", "y", "e", "o", "a", "para", "un", "una", "al",
    "del", "en", "su", "sus", "with", "and", "the", "in", "of", "for", "to", "ml", "gr", "g", "kg", "mg", "cl",
    "l", "cm", "mm", "x", "ud", "uds", "pack", "dx",
)
STOP_ARTERO = (
    "artero", "professional", "pet", "de", "el", "la", "los", "las", "con", "sin", "y", "para", "ml", "gr",
    "g", "kg", "l", "x", "oz", "ud", "uds", "ndr", "pv", "nv", "online", "a", "e", "o",
)
STOP_BEAPHAR = (
    "beaphar", "beapharm", "de", "el", "la", "los", "las", "con", "sin", "y", "e", "o", "a", "para", "un",
    "una", "ml", "gr", "g", "kg", "l", "cm", "mm", "x", "ud", "uds", "comp", "cpd", "dx",
)
STOP_MENFORSAN = (
    "menforsan", "de", "el", "la", "los", "las", "con", "sin", "y", "e", "o", "a", "para", "un", "una", "al",
    "ml", "gr", "g", "kg", "l", "cm", "mm", "x", "ud", "uds", "dx",
)
STOP_CHURU = (
    "inaba", "churu", "ciao", "stix", "gato", "gatos", "cat", "cats", "dog", "dogs", "perro", "perros", "de",
    "el", "la", "los", "las", "con", "sin", "y", "para", "e", "o", "al", "a", "un", "una", "g", "gr", "kg",
    "ml", "l", "x", "und", "treat", "treats", "snack", "snacks",
)
STOP_VIRBAC = (
    "virbac", "de", "el", "la", "los", "las", "con", "sin", "y", "para", "e", "o", "al", "un", "una", "a",
    "ml", "g", "mg", "mcg", "kg", "gr", "l", "x", "cm", "ud", "uds",
)
STOP_GENERIC = (
    "de", "la", "el", "los", "las", "con", "sin", "y", "e", "o", "a", "para", "un", "una", "al", "the", "and",
    "with", "for", "of", "kg", "gr", "g", "mg", "ml", "l", "lb", "cm", "mm", "x", "ud", "uds", "pack", "caja",
    "bolsa", "ndr", "pv", "nv", "online",
)
STOP_MARKETPLACE = (
    "de", "el", "la", "los", "las", "con", "sin", "y", "e", "o", "a", "para", "un", "una", "al", "en", "por",
    "su", "se", "que", "ml", "gr", "g", "kg", "l", "cm", "mm", "x", "ud", "uds", "the", "for", "and", "or",
    "of", "with",
)
STOP_VARIANT_IMAGE = (
    "de", "para", "con", "and", "for", "with", "gr", "g", "kg", "ml", "l", "x", "pcs", "ud", "uds", "pack",
    "caja",
)
STOP_FEED = (
    "the", "and", "for", "con", "para", "del", "los", "las", "una", "que", "mas", "food", "alimento", "diet",
    "de", "la", "el", "en", "y", "alpha", "spirit", "alphaspirit", "aspiritpetfood", "500g", "2kg", "9kg",
    "14kg", "35g", "85g", "300g", "150g", "gr", "kg", "g", "x", "pack", "copia",
)
STOP_VETLIFE = (
    "the", "and", "for", "con", "para", "del", "los", "las", "una", "que", "mas", "food", "alimento", "diet",
    "natural", "nat", "vetlife", "vet", "life", "farmina", "canine", "feline", "300g", "85g", "150g", "2kg",
    "3kg", "web", "sito", "amp", "adult", "adulto", "copia",
)
STOP_SELF = ("alpha", "spirit", "the", "de", "y", "con", "para", "a")

# ---------------------------------------------------------------------------
# Species and life-stage markers.
# ---------------------------------------------------------------------------
DOG_MARKERS = ("dog", "dogs", "perro", "perros", "canine", "canino")
CAT_MARKERS = ("cat", "cats", "gato", "gatos", "feline", "felino", "kitten", "gatito")
CAT_MARKERS_WIDE = CAT_MARKERS + ("gatitos",)
FEED_DOG_TITLE = ("canine", "canino", "perro")
FEED_CAT_TITLE = ("feline", "felino", "gato")
FEED_DOG_ENTRY = ("perros", "perro", "canine", "canino", "dog")
FEED_CAT_ENTRY = ("gatos", "gato", "feline", "felino", "kitten", "cat")
VETLIFE_DOG_TITLE = ("canine", "perro", "dog")
VETLIFE_CAT_TITLE = ("feline", "gato", "cat")

# ---------------------------------------------------------------------------
# One-hop synonyms, each word with its alternatives.
# ---------------------------------------------------------------------------
SYN_GENERIC = {
    "perro": ("dog",), "dog": ("perro",), "gato": ("cat",), "cat": ("gato",), "cachorro": ("puppy",),
    "puppy": ("cachorro",), "gatito": ("kitten",), "kitten": ("gatito",), "adulto": ("adult",),
    "adult": ("adulto",), "pollo": ("chicken",), "chicken": ("pollo",), "cordero": ("lamb",),
    "lamb": ("cordero",), "salmon": ("salmon",), "atun": ("tuna",), "tuna": ("atun",), "ternera": ("beef",),
    "vacuno": ("beef",), "beef": ("ternera", "vacuno"), "pavo": ("turkey",), "turkey": ("pavo",),
    "pato": ("duck",), "duck": ("pato",), "arroz": ("rice",), "rice": ("arroz",), "pescado": ("fish",),
    "fish": ("pescado",), "lata": ("can", "wet"), "humedo": ("wet",),
    "esterilizado": ("sterilised", "neutered"),
}
SYN_FARMINA = {
    "dog": ("perro",), "perro": ("dog",), "cat": ("gato",), "gato": ("cat",), "puppy": ("cachorro",),
    "cachorro": ("puppy",), "kitten": ("gatito",), "gatito": ("kitten",), "adult": ("adulto",),
    "adulto": ("adult",), "chicken": ("pollo",), "pollo": ("chicken",), "lamb": ("cordero",),
    "cordero": ("lamb",), "fish": ("pescado", "arenque"), "pescado": ("fish",), "cod": ("bacalao",),
    "bacalao": ("cod",), "herring": ("arenque",), "arenque": ("herring",), "boar": ("jabali",),
    "jabali": ("boar",), "pork": ("cerdo",), "cerdo": ("pork",), "lata": ("can", "wet", "humedo"),
    "can": ("lata",), "humedo": ("lata", "wet"), "caja": ("lata", "can", "wet"), "pomegranate": ("granada",),
    "granada": ("pomegranate",), "pumpkin": ("calabaza",), "calabaza": ("pumpkin",),
    "mini": ("small", "pequeno"), "maxi": ("large", "grande"), "renal": ("renal",),
    "neutered": ("neutered", "esterilizado"),
}
SYN_AFFINITY = {
    "pollo": ("chicken",), "chicken": ("pollo",), "cordero": ("lamb",), "lamb": ("cordero",),
    "arroz": ("rice",), "rice": ("arroz",), "salmon": ("salmon",), "ternera": ("beef", "veal"),
    "buey": ("ox", "beef"), "beef": ("ternera", "buey"), "veal": ("ternera",), "pavo": ("turkey",),
    "turkey": ("pavo",), "atun": ("tuna",), "tuna": ("atun",), "conejo": ("rabbit",), "rabbit": ("conejo",),
    "ganso": ("goose",), "goose": ("ganso",), "aves": ("poultry", "chicken", "bird"), "poultry": ("aves",),
    "pescado": ("fish",), "fish": ("pescado",), "adulto": ("adult",), "adult": ("adulto",),
    "cachorro": ("puppy",), "puppy": ("cachorro",), "senior": ("senior",),
    "esterilizado": ("sterilized", "sterilised"), "sterilized": ("esterilizado",),
    "sterilised": ("esterilizado",), "sensitivo": ("sensitive",), "sensit": ("sensitive",),
    "sensitive": ("sensitivo",), "ligero": ("light",), "light": ("ligero",), "grande": ("maxi", "large"),
    "mediano": ("medium",), "medium": ("mediano",), "pequeno": ("mini", "small"), "gatito": ("kitten",),
    "kitten": ("gatito",), "feline": ("cat", "gato"), "gato": ("feline", "cat"), "cat": ("feline", "gato"),
    "canine": ("dog", "perro"), "perro": ("canine", "dog"), "dog": ("canine", "perro"), "renal": ("renal",),
    "articular": ("articular", "joint"), "joint": ("articular",), "urinario": ("urinary",),
    "urinary": ("urinario",), "gastro": ("gastro", "gastrointestinal"), "gastrointestinal": ("gastro",),
    "hipoalergenico": ("hypoallergenic",), "hypoallergenic": ("hipoalergenico",), "atopico": ("atopic",),
    "atopic": ("atopico",), "hepatico": ("hepatic",), "hepatic": ("hepatico",),
}
SYN_CALIBRA = {
    "pollo": ("chicken",), "chicken": ("pollo",), "cordero": ("lamb",), "lamb": ("cordero",),
    "arroz": ("rice",), "rice": ("arroz",), "salmon": ("salmon",), "ternera": ("beef", "veal"),
    "buey": ("ox", "beef"), "beef": ("ternera", "buey"), "veal": ("ternera",), "pavo": ("turkey",),
    "turkey": ("pavo",), "atun": ("tuna",), "tuna": ("atun",), "conejo": ("rabbit",), "rabbit": ("conejo",),
    "pescado": ("fish",), "fish": ("pescado",), "pato": ("duck",), "duck": ("pato",), "venado": ("venison",),
    "venison": ("venado",), "vacuno": ("beef",), "tripa": ("tripe",), "tripas": ("tripe",),
    "callos": ("tripe",), "calabaza": ("pumpkin",), "bacalao": ("cod",), "pulmon": ("lung", "lungs"),
    "pulmones": ("lung", "lungs"), "espirulina": ("spirulina",), "yuca": ("yucca",), "yucca": ("yuca",),
    "ave": ("poultry",), "aves": ("poultry",), "poultry": ("ave", "pollo", "chicken"), "lata": ("can",),
    "semihumedo": ("semi", "moist"), "humedo": ("moist",), "arenque": ("herring",), "trucha": ("trout",),
    "higado": ("liver",), "jabali": ("boar", "wild"), "arandano": ("cranberry", "cran"),
    "arandanos": ("cranberry", "cran"), "manzana": ("apple",), "zanahoria": ("carrot", "carrots"),
    "salsa": ("gravy", "sauce"), "gravy": ("salsa",), "insectos": ("insect",), "insecto": ("insect",),
    "gambas": ("shrimp", "prawn"), "cobaya": ("guinea",), "cobayas": ("guinea",),
    "chinchilla": ("chinchilla",), "chinchillas": ("chinchilla",), "degu": ("degus",), "degus": ("degu",),
    "roedor": ("rodent", "rodents"), "roedores": ("rodent", "rodents"), "nuez": ("nut", "nuts"),
    "nueces": ("nut", "nuts"), "coco": ("coconut",), "verdura": ("vegetable", "vegetables", "vegeta"),
    "verduras": ("vegetable", "vegetables", "vegeta"), "fruta": ("fruit", "fruits"),
    "frutas": ("fruit", "fruits"), "silvestre": ("wild",), "adulto": ("adult",), "adult": ("adulto",),
    "cachorro": ("puppy", "junior"), "puppy": ("cachorro", "junior"), "junior": ("cachorro", "puppy"),
    "senior": ("senior", "mature"), "esterilizado": ("sterilised", "sterilized", "neutered"),
    "sterilised": ("esterilizado", "sterilized"), "sterilized": ("esterilizado", "sterilised"),
    "sensible": ("sensitive",), "sensitive": ("sensible",), "ligero": ("light",), "light": ("ligero",),
    "grande": ("maxi", "large"), "mediano": ("medium",), "medium": ("mediano",), "mini": ("pequeño", "small"),
    "gatito": ("kitten",), "kitten": ("gatito",), "gato": ("cat", "feline"), "cat": ("gato", "feline"),
    "feline": ("gato", "cat"), "perro": ("dog", "canine"), "dog": ("perro", "canine"),
    "canine": ("perro", "dog"), "renal": ("renal", "kidney"), "kidney": ("renal",),
    "hepatico": ("hepatic", "liver"), "hepatic": ("hepatico",), "urinario": ("urinary",),
    "urinary": ("urinario",), "digestivo": ("digestive", "gastrointestinal", "gastro"),
    "gastrointestinal": ("digestivo", "gastro"), "gastro": ("digestivo", "gastrointestinal"),
    "articular": ("joint", "mobility"), "joint": ("articular", "mobility"), "mobility": ("articular", "joint"),
    "hipoalergenico": ("hypoallergenic",), "hypoallergenic": ("hipoalergenico",),
    "recovery": ("recovery", "recuperacion"), "obesity": ("obesity", "obesidad", "weight"),
    "obesidad": ("obesity", "weight"), "diabetes": ("diabetes",), "premium": ("premium",),
    "life": ("life", "vida"), "verve": ("verve",), "expert": ("expert", "experto"),
    "nutrition": ("nutrition", "nutricion"), "veterinary": ("veterinaria", "vd", "vet"),
    "veterinaria": ("veterinary", "vd", "vet"), "vd": ("veterinary", "veterinaria"),
}

# ---------------------------------------------------------------------------
# Word-for-word translations, each source word with its target.
# ---------------------------------------------------------------------------
TR_APPLAWS = {
    "gato": "cat", "gatos": "cat", "gatito": "kitten", "gatitos": "kitten", "perro": "dog", "perros": "dog",
    "cachorro": "puppy", "cachorros": "puppy", "pollo": "chicken", "pechuga": "breast", "muslo": "thigh",
    "salmon": "salmon", "atun": "tuna", "pescado": "fish", "sardina": "sardine", "sardinas": "sardine",
    "caballa": "mackerel", "trucha": "trout", "cordero": "lamb", "ternera": "beef", "buey": "beef",
    "vacuno": "beef", "res": "beef", "pavo": "turkey", "pato": "duck", "conejo": "rabbit", "jamon": "ham",
    "higado": "liver", "gambas": "prawn", "gamba": "prawn", "langostinos": "prawn", "langostino": "prawn",
    "cangrejo": "crab", "queso": "cheese", "cerdo": "pork", "sobre": "pouch", "sobres": "pouch", "lata": "tin",
    "latas": "tin", "bolsa": "bag", "caldo": "broth", "gelatina": "jelly", "jalea": "jelly",
    "esparragos": "asparagus", "arroz": "rice", "verduras": "vegetable", "verdura": "vegetable",
    "vegetales": "vegetable", "calabaza": "pumpkin", "seco": "dry", "seca": "dry", "humedo": "wet",
    "humeda": "wet", "mojado": "wet", "mojada": "wet", "adulto": "adult", "adultos": "adult",
    "senior": "senior", "esterilizado": "sterilised", "esterilizada": "sterilised", "seleccion": "selection",
    "suprema": "supreme", "supremo": "supreme", "natural": "natural", "naturaleza": "nature",
    "arena": "litter", "multipack": "multipack", "comida": "food", "alimento": "food", "filete": "fillet",
    "filetes": "fillet", "trozos": "chunks", "trozo": "chunks", "tarrina": "pot", "tarrinas": "pot",
    "tarro": "pot", "receta": "recipe", "pate": "pate", "mousse": "mousse", "anchoas": "anchovy",
    "anchoa": "anchovy", "mar": "ocean",
}
TR_CHURU = {
    "atun": "tuna", "pollo": "chicken", "gambas": "shrimp", "camaron": "shrimp", "cangrejo": "crab",
    "salmon": "salmon", "venado": "venison", "pato": "duck", "ternera": "beef", "cerdo": "pork",
    "cordero": "lamb", "queso": "cheese", "verdura": "vegetable", "fruta": "fruit", "leche": "milk",
    "caballa": "mackerel", "dorada": "sea-bream", "trucha": "trout", "vieira": "scallop", "almeja": "clam",
}
TR_FEED = {
    "pollo": "chicken", "pescado": "fish", "cordero": "lamb", "pato": "duck", "ternera": "beef",
    "conejo": "rabbit", "salmon": "salmon", "trucha": "trout", "atun": "fish", "dorada": "seabream",
    "jamon": "ham", "pavo": "turkey", "cerdo": "pork", "vaca": "beef", "buey": "beef", "ciervo": "venison",
    "venado": "venison", "jabali": "boar", "semihumedo": "semiwet", "humedo": "wet", "caja": "wet",
    "tarro": "wet", "seco": "dry", "cachorro": "puppy", "cachorros": "puppies", "adulto": "adult",
    "adultos": "adult", "snack": "snack", "snacks": "snack", "multiproteico": "multiprotein",
    "sardina": "sardine", "boqueron": "anchovy", "iberico": "iberian", "toro": "beef", "puppy": "puppies",
    "kittens": "kitten", "esterilizado": "sterilized", "esterilizados": "sterilized",
}
TR_VETLIFE = {
    "pescado": "fish", "cerdo": "pork", "pato": "duck", "huevo": "egg", "pollo": "chicken", "trucha": "fish",
    "cachorro": "puppy", "adulto": "adult", "humedo": "humedo", "caja": "humedo", "tarro": "humedo",
}

# ---------------------------------------------------------------------------
# Substrings that mark an image URL as decoration, per profile.
# ---------------------------------------------------------------------------
_JUNK = (
    ".svg", "logo", "icon", "banner", "sprite", "placeholder", "favicon", "loader", "spinner", "flag", "pixel",
)
_VIDEO = ("hqdefault", "maxresdefault", "sddefault")
IMAGE_BLACKLIST = {
    "generic_search": (
    ".svg", "logo", "icon", "sprite", "placeholder", "favicon", "loader", "spinner", "pixel", "banner",
),
    "farmina": _JUNK,
    "churu": _JUNK,
    "virbac": _JUNK,
    "applaws": _JUNK + ("/static/", "woocommerce-placeholder"),
    "beaphar": _JUNK + ("/static/",) + _VIDEO,
    "menforsan": _JUNK + ("/static/",) + _VIDEO,
    "artero": (
    ".svg", "logo", "icon", "banner", "sprite", "placeholder", "favicon", "_bnd", "/static/", "/.renditions/",
) + _VIDEO,
    "supplier": _JUNK + (
    "/static/", "blank", "noimage", "sin-imagen", "sinimagen", "nofoto", "carrito", "boton", "btn-",
),
}
MARKETPLACE_SPRITES = (
    "play-icon", "overlay", "sprite", "gno/", "/x-locale/", "transparent-pixel", "grey-pixel",
)

# ---------------------------------------------------------------------------
# Words that reveal a product form.
# ---------------------------------------------------------------------------
FEED_WET = (
    "CAJA", "TARRO", "HUMEDO", "HÚMEDO", "WET", "MOUSSE", "PATE", "PATÉ", "ESTOFADO", "SALCHICHA", "LATA",
    "ALBONDIG", "POUCH",
)
FEED_SNACK = (
    "snack", "barrita", "bocadito", "hueso", "premio", "treat", "lonchita", "ristra", "nervio", "oreja",
)
VETLIFE_WET = ("CAJA", "TARRO", "X300", "X85", "HUMEDO")

# Slug corrections (title slug → page slug).
SLUG_CORRECTIONS = {
    "artero-higiene-perfume-violet-90ml": "artero-perfume-violet-90ml",
    "artero-espuma-acondicionador-zoom": "artero-espuma-voluminizadora-zoom-150ml",
}

# Sub-brand prefixes, tried in this order.
SUB_BRANDS = (
    ("advance_vet", ("ADVANCE VET", "ADVANCE DIETS", "ADVANCE VETERINARY")),
    ("advance", ("ADVANCE", "AD ")),
    ("brekkies", ("BREKKIES",)),
    ("libra", ("LIBRA",)),
    ("natural_trainer", ("NATURAL TRAINER", "NATURAL TRAI")),
    ("natures_variety", ("NATURE'S VARIETY", "NATURE'S V", "NATURES VARIETY")),
)
SUB_BRAND_NAMES = {
    "advance": "Advance",
    "advance_vet": "Advance Veterinary Diets",
    "libra": "Libra",
    "brekkies": "Brekkies",
    "natural_trainer": "Natural Trainer",
    "natures_variety": "Nature's Variety",
}

# Image confirmation thresholds (same, different) and gates per backend.
IMAGE_BANDS = {"clip": (0.82, 0.62), "hash": (0.86, 0.72)}
IMAGE_GATE = {"clip": 0.60, "hash": 0.80}


@dataclass(frozen=True)
class MatcherProfile:
    """One row of the matcher table.

    ``text``      how a title becomes tokens: ``plain``, ``preprocess`` (feed style,
                  one-letter words kept).
    ``units``     ``after`` splits number and unit once cleaned, ``before`` splits glued
                  units first, ``""`` leaves them.
    ``stem``/``syn``/``translate``  rewriting of tokens, applied in the order
                  translate → synonyms → stem.
    ``translate_catalog`` whether the catalogue side is translated as well.
    ``accept``    lowest score that is a match (inclusive).
    ``tie``       ``first_ord`` | ``handle_desc`` | ``canonical_url_desc``.
    ``species``   ``""`` | ``symmetric`` | ``asymmetric``.
    """

    name: str
    stop: tuple[str, ...]
    accept: float
    text: str = "plain"
    units: str = ""
    stem: bool = False
    syn: tuple[tuple[str, tuple[str, ...]], ...] = ()
    translate: tuple[tuple[str, str], ...] = ()
    translate_catalog: bool = False
    drop_numbers: bool = False
    tie: str = "first_ord"
    species: str = ""
    stage_factor: float = 1.0
    early_stop: float | None = None
    accept_with_image: float | None = None
    tie_margin: float = 0.0
    gate: float | None = None
    gate_on_hash: bool = False
    top_k: int | None = None


def _syn(d: dict) -> tuple:
    return tuple(d.items())


#: The matcher plug-ins, as data.
PROFILES: dict[str, MatcherProfile] = {
    p.name: p
    for p in (
        MatcherProfile("acana", STOP_ACANA, 0.20),
        MatcherProfile("acana_legacy", STOP_ACANA_LEGACY, 0.10),
        MatcherProfile("affinity", STOP_AFFINITY, 0.12, syn=_syn(SYN_AFFINITY)),
        MatcherProfile("calibra", STOP_CALIBRA, 0.30, syn=_syn(SYN_CALIBRA), species="symmetric",
                       tie_margin=0.08, gate=0.60),
        MatcherProfile("farmina", STOP_FARMINA, 0.25, syn=_syn(SYN_FARMINA), stem=True,
                       species="symmetric", accept_with_image=0.12, gate=0.60, top_k=8),
        MatcherProfile("vetlife_legacy", STOP_VETLIFE, 0.10, text="preprocess",
                       translate=_syn(TR_VETLIFE), translate_catalog=True),
        MatcherProfile("alpha_spirit", STOP_FEED, 0.10, text="preprocess",
                       translate=_syn(TR_FEED), translate_catalog=True),
        MatcherProfile("alpha_spirit_report", STOP_FEED, 0.10, text="preprocess",
                       translate=_syn(TR_FEED), translate_catalog=True),
        MatcherProfile("applaws_es", STOP_APPLAWS, 0.30, units="after", stem=True),
        MatcherProfile("applaws_uk", STOP_APPLAWS, 0.22, units="after", stem=True,
                       translate=_syn(TR_APPLAWS), drop_numbers=True, tie="handle_desc",
                       species="asymmetric", stage_factor=0.5),
        MatcherProfile("artero", STOP_ARTERO, 0.10),
        MatcherProfile("beaphar", STOP_BEAPHAR, 0.34, stem=True, early_stop=0.85),
        MatcherProfile("menforsan", STOP_MENFORSAN, 0.30, stem=True, early_stop=0.85),
        MatcherProfile("churu_es", STOP_CHURU, 0.20, stem=True, early_stop=0.85),
        MatcherProfile("churu_us", STOP_CHURU, 0.20, stem=True, early_stop=0.85,
                       translate=_syn(TR_CHURU)),
        MatcherProfile("virbac_store", STOP_VIRBAC, 0.20, stem=True, early_stop=0.85),
        MatcherProfile("virbac_vet", STOP_VIRBAC, 0.20, stem=True, early_stop=0.85),
        MatcherProfile("generic_search", STOP_GENERIC, 0.22, syn=_syn(SYN_GENERIC),
                       species="symmetric", accept_with_image=0.10, gate=0.60, top_k=4),
        MatcherProfile("marketplace", STOP_MARKETPLACE, 0.35, units="before"),
    )
}

#: Floor the orchestrating job applies after any profile.
RESOLUTION_FLOOR = 0.10


def profile_table(spark: SparkSession) -> DataFrame:
    """The matcher profiles as a DataFrame (one row per profile)."""
    rows = [
        (p.name, p.text, p.units, p.stem, bool(p.syn), bool(p.translate), p.accept, p.tie, p.species,
         p.stage_factor, p.early_stop, p.accept_with_image, p.tie_margin, p.gate, p.top_k)
        for p in PROFILES.values()
    ]
    return spark.createDataFrame(
        rows,
        "profile string, text string, units string, stem boolean, has_synonyms boolean, "
        "has_translation boolean, accept double, tie string, species string, stage_factor double, "
        "early_stop double, accept_with_image double, tie_margin double, gate double, top_k int",
    )


def lexicon_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """``stop(profile, token)``, ``syn(profile, token, syn)``, ``tr(profile, src, dst)``."""
    stop = [(p.name, w) for p in PROFILES.values() for w in p.stop]
    syn = [(p.name, w, s) for p in PROFILES.values() for w, alts in p.syn for s in alts]
    tr = [(p.name, a, b) for p in PROFILES.values() for a, b in p.translate]
    return {
        "stop": spark.createDataFrame(stop, "profile string, token string"),
        "syn": spark.createDataFrame(syn, "profile string, token string, syn string"),
        "tr": spark.createDataFrame(tr, "profile string, src string, dst string"),
    }
