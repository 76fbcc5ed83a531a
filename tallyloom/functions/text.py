"""Text, number and date expressions for messy sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ------------------------------------------------------------------ fixed values
# Item name patterns and the category they mean, first match wins.
CATEGORY_RULES = (
    ("Outerwear", r"(\b(hoodies?|jackets?|windbreakers?|sweaters?|pullovers?|bombers?)\b|\bsweat\s*shirts?\b|\bsweatshirts?\b|\bmachete\b|\btaslan\b)"),
    ("Shirts & Tops", r"(\w*t-?shirts?\b|\w*shirts?\b|\bpolos?\b|\bpolo\s*shirts?\b|\bjerseys?\b|\btees?\b|\bsubli\w*|\boversized\b|\bcrew\s*neck\b|\buniforms?\b|\bdri-?\s*fit\b|\bembro\w*|\bos\b|^go uste\b|\bvl ust\b|^gt\b|golden tigresses|happy tiger|\bshorts?\b|tiger pattern|\bquiana\b|\bquina\b|\bathletic\b|\bbasketball v\.\d|\barchitecture\b|\bcollar\b|\bline design\b)"),
    ("Bags", r"(\btote\s*bags?\b|\btotebags?\b|\btotes?\b|\beco\s*bags?\b|\bbags?\b|\bpouch\w*|\bsling\b|\bbackpacks?\b|\bback\s*packs?\b)"),
    ("Drinkware", r"(\b(mugs?|tumblers?|bottles?|sippers?|jugs?)\b|\w*flasks?\b|\bcups?\b)"),
    ("Lanyards & IDs", r"(\blanyards?\b|\blaces?\b|\bid\s*cases?\b|\bid\s*holders?\b|\bribbons?\b|\bi\.d\s*cases?\b|\bretractable\b)"),
    ("Keychains & Charms", r"(\bkey\s*chains?\b|\bkeychains?\b|\bcharms?\b|\bclickers?\b|\bfidgets?\b|\bpins?\b|\bbrooch\w*)"),
    ("Stationery", r"(\bball\s*pens?\b|\bpens?\b|\bpencils?\b|\bnotebooks?\b|\bnb\b|\bnotelets?\b|\bstickers?\b|\bplanners?\b|\bbookmarks?\b|\bfolders?\b|\bpapers?\b|\berasers?\b|\brulers?\b|\bpaperweights?\b)"),
    ("Plush & Souvenirs", r"(\bplushi?e?s?\b|\bplush\b|\bstuff(ed)?\s*toys?\b|\btoys?\b|\bclappers?\b|\barch\b|\bfigurines?\b|\btokens?\b|\bw/?\s*box\b|\btiger\s*w\b|\bcars?\b|^(big|small) tiger\b|\bmain building\b)"),
    ("Apparel Accessories", r"(\bscarf\b|\bscarves\b|\bsash\b|\bhead\s*bands?\b|\bwrist\s*bands?\b|\bbracelets?\b|\bgloves?\b|\bballer\b|\btiger claw\b|\bblankets?\b|\bhair\s*bands?\b|\bcostumes?\b|\bcustome\b)"),
    ("Umbrellas & Gear", r"(\bumbrellas?\b|\bumb\b|\bcanopy\b|\bcaps?\b|\bhats?\b|\bsocks?\b|\btowels?\b|\bfans?\b|\bshoes?\b)"),
    ("Home & Novelty", r"(\bclocks?\b|\butensils?\b|\bmouse\s*pads?\b|\blamps?\b|\bframes?\b|\bmagnets?\b|\bcoasters?\b|\bpower\s*banks?\b|\bchargers?\b)"),
    ("Bundles & Vouchers", r"(\bkits?\b|\bbundle\b|\bvouchers?\b)"),
)
RESIDUE = "Uncategorised"
# Store section patterns with where the rule comes from, first match wins.
SECTION_RULES = (
    ("Vouchers", "list", r"\bvoucher"),
    ("Costumes", "list", r"\bcost?ume\b|\bcustome\b"),
    ("Bundles & Gift Sets", "list", r"\bkit\b"),
    ("Toys and Plushies", "list", r"\bcar\b|plush|stuff\s*toy"),
    ("Jersey", "list", r"\bjersey\b"),
    ("Jackets, Hoodies, Sweatshirt", "list", r"hoodie|jacket|windbreaker|breaker|sweatshirt|bomber|machete|taslan"),
    ("Polo Shirts", "list", r"\bpolo|poloshirt|subli\w*\s+(yellow|2 color)"),
    ("Shirts", "name", r"(architecture|cics|cthm|engineering|fine arts|pharmacy|tourism|commerce|college of science|ipea|absc|arts & letters)"),
    ("Shirts", "list", r"shirt|embro|dri-?\s*fit|dry fit|oversize|\bos\b|golden tigresses|happy tiger|tiger pattern|quiana|quina|go uste|\bvl ust"),
    ("Premium Pens", "list", r"insignia|blanca|picasso|w/\s*box|with box"),
    ("Gift & Souvenir Items", "list", r"sticker|key\s*chain|clicker|\bpins?\b|\barch\b|clock|utensil|clapper"),
    ("Writing & Stationery", "list", r"\bpens?\b|ballpen|pencil|notebook|\bnb\b|notelet|bookmark|ust-pen"),
    ("Bags", "list", r"\bbags?\b|\btote|back\s*pack"),
    ("Mugs & Tumblers", "list", r"\bmug|tumbler|aquaflask|\bcup\b"),
    ("Lanyards & ID Accessories", "list", r"lanyard|\blace\b|i\.?d\s*case"),
    ("Accessories, Tech (Textiles & Wearables)", "list", r"scarf|scarves|headband|\bcaps?\b|\bhat\b|trucker|umbrella|\bumb\b|\bumb\.|canopy|power\s*bank|powerbank|blanket"),
    ("Accessories, Tech (Textiles & Wearables)", "name", r"\bsash\b|\bsocks?\b|charger"),
)
SECTION_RESIDUE = "Uncategorized"
APPAREL_TAGS = {"APPAREL": "apparel", "NON-APPAREL": "non-apparel", "MAIN STORAGE": "non-apparel"}
APPAREL_PARTS = ("shirt", "jersey", "jacket", "hoodie", "sweatshirt", "poloshirt", "uniform", "blouse", "costume",
                 "embro", "oversized", "varsity", "dri-fit", "drifit", "taslan", "subli", "headband", "blazer")
APPAREL_WORDS = ("cap", "caps", "hat", "hats", "vest", "coat", "sash", "scarf", "scarfs", "scarves", "socks", "dress",
                 "skirt", "pants", "short", "shorts", "robe", "gown", "polo")
TYPE_RULES = (
    ("drinkware", r"tumbler|mug|flask|aquaflask"),
    ("bags", r"back ?pack|laptop bag|tote|sling bag|eco bag|paper bag|\bbag\b"),
    ("toys_plush", r"plushie|plush|stuff toy|stuffed toy|mystery car|\bcar\b|machete|tiger costume"),
    ("umbrella", r"umbrella|\bumb\b|canopy|\bcane\b"),
    ("stationery", r"notebook|notelet|bookmark|pencil|\bpen\b|ballpen|paper weight|paperweight"),
    ("accessories", r"keychain|lanyard|sticker|\bpin\b|pins|id case|id lace|clicker|clapper|\bclock\b|charger|powerbank"),
)
LEAD_RULES = ((28, "jacket", r"jacket|windbreaker"), (18, "embroidered_shirt", r"embro"),
              (14, "simple_dtf_puff_shirt", r"shirt|jersey|polo|\btee\b"))
LEAD_DEFAULT = 18
ORDER_SPELLINGS = {
    "walk_in": ("walkin", "walk", "counter", "regular", "no", "n", "false", "0"),
    "bulk": ("bulk", "bulkorder", "organisation", "organization", "org", "organisationorder", "organizationorder",
             "yes", "y", "true", "1"),
    "pre_order": ("preorder", "pre", "reservation", "reserved"),
}
STATUS_RULES = (
    ("OPS_NONSELLING", ("PREPARATION", "CLEANING", "INVENTORY", "INVTY", "MAINTENANCE", "BENCH-MARKING", "BENCHMARKING",
                        "PLANNING", "MEETING", "ASSEMBLY", "TEAM BUILDING", "SPORTSFEST", "THANKSGIVING PARTY", "RETREAT",
                        "HIYAS", "UAAP CLOSING", "GENERAL CLEANING")),
    ("CLOSED", ("NO OPERATION", "HOLIDAY", "DAY OF VALOR", "INDEPENDENCE DAY", "EID'L", "EIDL", "EDSA", "MANILA DAY",
                "BLACK NAZARENE", "ST. THOMAS AQUINAS", "CHINESE NEW YEAR", "ELECTION DAY", "ALL SAINTS", "ALL SOULS",
                "CHRISTMAS", "NEW YEAR")),
    ("SUSPENSION", ("SUSPENSION", "VIRTUAL MODE", "EVM", "STRIKE", "TYPHOON", "WALANG PASOK", "NO CLASS")),
    ("SELLING_SPECIAL", ("SELLING", "USTET", "VOLLEYBALL", "GAME", "MATHED", "FAIR", "BAZAAR")),
)
NOISE_WORDS = ("ust", "print", "with", "the", "of", "and", "new", "design", "designs", "assorted", "all")
EVENT_STOP = ("of", "the", "in", "and", "a", "an", "to", "for", "with", "on", "st", "ust", "day", "honor", "date",
              "uncertain", "verify", "begin", "begins", "activities", "virtual", "person")
PRICE_SUFFIX = r"@\s*(\d+(?:\.\d+)?)"
# ----------------------------------------------------------------- end fixed values


def _ladder(pairs, default: Column) -> Column:
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def rule_label(name: Column, rules, default: str) -> Column:
    low = F.lower(name)
    return _ladder([(low.rlike(pat), F.lit(label)) for label, pat in rules], F.lit(default))


def category_of(name: Column) -> Column:
    return rule_label(name, CATEGORY_RULES, RESIDUE)


def section_of(name: Column, override: Column) -> Column:
    """Section and its basis; a per-item override comes first."""
    low = F.lower(name)

    def pair(section, basis):
        return F.struct(section.alias("section"), F.lit(basis).alias("basis"))

    return _ladder([(override.isNotNull(), pair(override, "override"))]
                   + [(low.rlike(pat), pair(F.lit(sec), basis)) for sec, basis, pat in SECTION_RULES],
                   pair(F.lit(SECTION_RESIDUE), "none"))


def is_apparel_name(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return low.rlike("|".join(APPAREL_PARTS)) | low.rlike(r"\b(" + "|".join(APPAREL_WORDS) + r")\b")


def apparel_class(name: Column, tag: Column) -> Column:
    return _ladder([(tag == k, F.lit(v)) for k, v in APPAREL_TAGS.items()],
                   F.when(is_apparel_name(name), "apparel").otherwise("non-apparel"))


def product_type(name: Column, tag: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    clothes = F.coalesce(tag == "APPAREL", F.lit(False)) | is_apparel_name(name)
    return _ladder([(clothes, F.lit("clothes"))] + [(low.rlike(p), F.lit(t)) for t, p in TYPE_RULES], F.lit("misc"))


def lead_time(name: Column, tag: Column) -> Column:
    """struct(days, label) from the garment kind."""
    low = F.lower(name)

    def pair(days, label):
        return F.struct(F.lit(days).alias("days"), F.lit(label).alias("label"))

    return _ladder([(F.coalesce(tag == "NON-APPAREL", F.lit(False)), pair(LEAD_DEFAULT, "default (confirmed non-apparel)"))]
                   + [(low.rlike(p), pair(d, lab)) for d, lab, p in LEAD_RULES],
                   pair(LEAD_DEFAULT, "default (uncategorized)"))


def order_type(text: Column, default: str | None = "walk_in") -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]", "")
    return _ladder([(key == "", F.lit(default))] + [(key.isin(*v), F.lit(k)) for k, v in ORDER_SPELLINGS.items()],
                   F.lit(None).cast("string"))


def day_status(label: Column, override: Column) -> Column:
    text = F.upper(F.trim(label))
    hit = [(F.coalesce(text, F.lit("")) == "", F.lit("NORMAL")), (override.isNotNull(), override)]
    for status, words in STATUS_RULES:
        cond = text.contains(words[0])
        for w in words[1:]:
            cond = cond | text.contains(w)
        hit.append((cond, F.lit(status)))
    return _ladder(hit, F.lit("UNKNOWN"))


def fold_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")


def _stem(t: Column) -> Column:
    n = F.length(t)
    return (F.when((n > 4) & t.endswith("ves"), F.concat(t.substr(F.lit(1), n - 3), F.lit("f")))
            .when((n > 4) & t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
            .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), n - 1)).otherwise(t))


def name_tokens(name: Column) -> Column:
    """Stemmed words of an item name without price suffixes and noise words."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), PRICE_SUFFIX, " ")
    s = F.regexp_replace(s, r"\bw/\s*", " with ")
    words = F.filter(F.split(s, r"[^a-z0-9]+"), lambda w: w != "")
    noise = F.array(*[F.lit(w) for w in NOISE_WORDS])
    return F.filter(F.transform(words, _stem), lambda w: ~F.array_contains(noise, w))


def event_words(name: Column) -> Column:
    """Distinct words (over two letters, no stop words) that identify an event."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", " ")
    stop = F.array(*[F.lit(w) for w in EVENT_STOP])
    words = F.filter(F.split(s, r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(words, lambda w: F.when(
        w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)))


def price_suffix(name: Column) -> Column:
    return F.regexp_extract(name, PRICE_SUFFIX, 1).try_cast("double")


def without_price_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*" + PRICE_SUFFIX, ""))


def strict_date(text: Column) -> Column:
    """ISO dates only; anything else, or an impossible day, is NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_int(text: Column) -> Column:
    """``9,980 pcs.`` -> 9980, ``5.0`` -> 5; a fraction is NULL."""
    num = F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(num == F.floor(num), num.cast("long"))


# Words that tell products apart.
COLOUR_WORDS = ("black", "white", "blue", "red", "yellow", "green", "gray", "grey", "maroon", "pink", "orange", "purple", "navy", "gold", "golden",
                "silver", "brown", "beige", "tiger", "camo")
SIZE_WORDS = ("xs", "s", "m", "l", "xl", "xxl", "xxxl", "small", "medium", "large", "kids", "adult", "junior")
PRODUCT_CODE = r"\(([A-Za-z]{2,5}-?[A-Za-z0-9]{2,6})\)"
NUMBER = r"\d+\.?\d*"


def spelling_key(name: Column) -> Column:
    """Lower case, single blanks, none around a slash."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(s, r"\s*/\s*", "/")


def product_marks(name: Column) -> Column:
    """struct(colours, sizes, code, numbers): what makes equal-sounding names different products."""
    low = F.lower(name)
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))

    def among(vocabulary):
        return F.array_join(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))), " ")

    code = F.upper(F.regexp_extract(name, PRODUCT_CODE, 1))
    numbers = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(NUMBER), F.lit(0)))), " ")
    return F.struct(among(COLOUR_WORDS).alias("colours"), among(SIZE_WORDS).alias("sizes"), F.when(code != "", code).alias("code"), numbers.alias("numbers"))
