"""Categories of a record from explicit values, aliases and keywords of its description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.columns import lookup
from wardloom.functions.text import normalize_description, normalize_key
from wardloom.operators.terms import dealt_join, occurrences
from wardloom.vocab import SECTORS, UNKNOWN

UNCLASSIFIED = "UNCLASSIFIED"
LANGUAGE_BOOST = 3.0
# Confidence and name of each way in which a category was found.
SOURCES = {"explicit": 0.95, "explicit_sub_category": 0.90, "explicit_category+inferred_sub_category": 0.85, "inferred": 0.70, "category_only": 0.55, "fallback": 0.0}

#: Our own dictionary: category -> names it is known by.
CATEGORY_ALIASES = {
    "WATER": ("water", "water supply", "drinking water", "jal"), "ELECTRICITY": ("electricity", "power", "energy", "bijli"), "ROAD": ("road", "roads", "street", "sadak"), "SANITATION": ("sanitation", "waste", "garbage", "cleanliness"),
    "HEALTHCARE": ("healthcare", "health", "medical", "hospital"), "EDUCATION": ("education", "school", "schools"), "TRANSPORT": ("transport", "bus", "transit"), "DIGITAL_CONNECTIVITY": ("digital connectivity", "internet", "network"),
    "HOUSING": ("housing", "house", "shelter"), "PUBLIC_SAFETY": ("public safety", "safety", "crime", "police"),
}
#: (category, sub_category) -> names it is known by; a name may stand under several.
SUB_CATEGORY_ALIASES = {
    ("WATER", "WATER_SUPPLY_DISRUPTION"): ("no water", "supply cut", "disruption"), ("WATER", "WATER_QUALITY"): ("dirty water", "quality"), ("ELECTRICITY", "POWER_OUTAGE"): ("power cut", "outage", "disruption"), ("ELECTRICITY", "STREET_LIGHTING"): ("street light", "lighting"),
    ("ROAD", "DAMAGED_ROAD"): ("pothole", "damaged road"), ("SANITATION", "DRAINAGE"): ("drain", "drainage"), ("SANITATION", "SOLID_WASTE"): ("solid waste", "garbage pile"), ("EDUCATION", "TEACHER_SHORTAGE"): ("no teacher", "teacher shortage"), ("HEALTHCARE", "MEDICINE_SHORTAGE"): ("no medicine", "medicine shortage"),
}
#: (category, sub_category or None, language, keyword): looked for anywhere in a description.
KEYWORDS = (
    ("WATER", "WATER_SUPPLY_DISRUPTION", "en", "no water"), ("WATER", "WATER_SUPPLY_DISRUPTION", "en", "water supply"), ("WATER", "WATER_SUPPLY_DISRUPTION", "romanised", "paani nahi"), ("WATER", "WATER_QUALITY", "en", "dirty water"), ("WATER", None, "en", "water"), ("WATER", None, "hi", "पानी"), ("WATER", None, "ta", "தண்ணீர்"),
    ("ELECTRICITY", "POWER_OUTAGE", "en", "power cut"), ("ELECTRICITY", "POWER_OUTAGE", "romanised", "bijli nahi"), ("ELECTRICITY", "STREET_LIGHTING", "en", "street light"), ("ELECTRICITY", None, "hi", "बिजली"), ("ELECTRICITY", None, "en", "electric"),
    ("ROAD", "DAMAGED_ROAD", "en", "pothole"), ("ROAD", "DAMAGED_ROAD", "en", "broken road"), ("ROAD", "DAMAGED_ROAD", "ta", "சாலை பழுது"), ("ROAD", None, "en", "road"), ("ROAD", None, "hi", "सड़क"),
    ("SANITATION", "DRAINAGE", "en", "drain"), ("SANITATION", "SOLID_WASTE", "en", "garbage"), ("SANITATION", "SEWAGE", "en", "sewage"), ("HEALTHCARE", "MEDICINE_SHORTAGE", "en", "no medicine"), ("HEALTHCARE", "HOSPITAL_ACCESS", "en", "hospital"), ("HEALTHCARE", None, "en", "clinic"),
    ("EDUCATION", "TEACHER_SHORTAGE", "en", "no teacher"), ("EDUCATION", "SCHOOL_INFRASTRUCTURE", "en", "school building"), ("EDUCATION", None, "en", "school"), ("TRANSPORT", "BUS_SHELTER", "en", "bus stop"), ("TRANSPORT", None, "en", "bus "),
    ("DIGITAL_CONNECTIVITY", "INTERNET_CONNECTIVITY", "en", "internet"), ("HOUSING", "LAND_ENCROACHMENT", "en", "encroachment"), ("PUBLIC_SAFETY", "STREET_CRIME", "en", "theft"), ("PUBLIC_SAFETY", "WOMEN_SAFETY", "en", "harassment"),
)


def _key(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def resolve_category(x: str) -> Column:
    """The category that a name stands for; of several an allowed one first, then by name."""
    names: dict[str, list[str]] = {}
    for category, aliases in CATEGORY_ALIASES.items():
        for a in (category, *aliases):
            names.setdefault(_key(a), []).append(category)
    return lookup(normalize_key(x), {k: min(v, key=lambda c: (c not in SECTORS, c)) for k, v in names.items()})


def resolve_sub_category(x: str, category: Column) -> tuple[Column, Column, Column]:
    """(category, sub_category, mismatch) that a name stands for: of the given category if there is one, else the first allowed. mismatch: the name is another category's."""
    names: dict[str, list[tuple[str, str]]] = {}
    for (c, sub), aliases in SUB_CATEGORY_ALIASES.items():
        for a in dict.fromkeys((_key(sub), *map(_key, aliases))):
            names.setdefault(a, []).append((c, sub))
    first = {k: min(v, key=lambda p: (p[0] not in SECTORS, p)) for k, v in names.items()}
    key = normalize_key(x)
    with_hint = lookup(F.concat_ws("|", category, key), {f"{c}|{k}": sub for k, v in names.items() for c, sub in reversed(v)})
    known = lookup(key, {k: p[1] for k, p in first.items()})
    sub = F.when(category.isNotNull(), with_hint).otherwise(known)
    return F.when(category.isNotNull() & sub.isNotNull(), category).otherwise(F.when(category.isNull(), lookup(key, {k: p[0] for k, p in first.items()}))), sub, category.isNotNull() & known.isNotNull() & with_hint.isNull()


def best_keyword(text: str, language: str, category: str | None, with_sub: bool) -> Column:
    """The keyword in a text with the best score: its length, and three more in the record's language.

    Of each (category, sub_category) the longest keyword that is found counts; ties go to the lesser keyword. With a category only its own keywords are looked for.
    """
    words = F.array(*[F.struct(F.lit(w).alias("keyword"), F.lit(lang).alias("language"), F.lit(c).alias("category"), F.lit(s).alias("sub_category")) for c, s, lang, w in KEYWORDS if (s is not None) == with_sub])
    found = F.filter(words, lambda k: F.contains(F.col(text), k["keyword"]) & (F.lit(True) if category is None else F.col(category).isNull() | (k["category"] == F.col(category))))
    same = lambda a, b: (a["category"] == b["category"]) & a["sub_category"].eqNullSafe(b["sub_category"])
    longer = lambda a, b: (F.length(a["keyword"]) > F.length(b["keyword"])) | ((F.length(a["keyword"]) == F.length(b["keyword"])) & (a["keyword"] < b["keyword"]))
    own = F.filter(found, lambda k: ~F.exists(found, lambda o: same(o, k) & longer(o, k)))
    scored = F.transform(own, lambda k: F.struct((-(F.length(k["keyword"]) + F.when(k["language"].eqNullSafe(F.col(language)), LANGUAGE_BOOST).otherwise(0.0))).alias("score"), k["keyword"].alias("keyword"), k["category"].alias("category"), k["sub_category"].alias("sub_category")))
    return F.array_min(scored)


def keyword_matches(rows: DataFrame, dictionary: DataFrame, key: str, text: str, language: str, category: str | None = None) -> DataFrame:
    """(key, rank, score, keyword, category, sub_category): what ``best_keyword`` chooses from, best first, for a table of keywords of any size.

    dictionary: (category, sub_category or null, language, keyword). Of each (category, sub_category) the longest keyword in a text counts, then the least; its score is
    its length, and three more in the row's language. With category, only keywords of the row's own count where it has one. A row without a match gives no row; keys are unique.
    """
    entries = dictionary.select(F.lower("keyword").alias("term"), F.col("language").alias("__language"), F.col("category").alias("__category"), F.col("sub_category").alias("__sub"))
    found = dealt_join(occurrences(rows, entries, key, text).drop("starts"), entries, key)
    told = rows.select(key, F.col(language).alias("__own"), (F.lit(None).cast("string") if category is None else F.col(category)).alias("__hint"))
    met = found.join(told, key).where("__hint is null or __hint = __category")
    other = F.when(F.col("__language").eqNullSafe(F.col("__own")), 0).otherwise(1).alias("other")
    per = met.groupBy(key, "__category", "__sub").agg(F.min(F.struct((-F.length("term")).alias("n"), "term", other)).alias("__k"))
    score = (F.when(F.col("__k.other") == 0, LANGUAGE_BOOST).otherwise(0.0) - F.col("__k.n")).alias("score")
    out = per.select(key, score, F.col("__k.term").alias("keyword"), F.col("__category").alias("category"), F.col("__sub").alias("sub_category"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "keyword", "category", "sub_category")
    return out.select(key, F.row_number().over(order).alias("rank"), "score", "keyword", "category", "sub_category")


def normalize(rows: DataFrame, category: str = "category", sub_category: str = "sub_category", language: str = "language", description: str = "description", dictionary: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """rows with norm_category, norm_sub_category, norm_confidence, norm_source, norm_keyword, norm_mismatch.

    Explicit names come first, through the aliases; a missing sub-category is sought by keyword, within the category if that is
    known; then a category alone; else UNKNOWN. Each row by itself: no shuffle. With a dictionary as ``keyword_matches`` takes it, and the rows' unique
    key, its keywords are looked for instead of the short list of this module, and what is found is joined to the rows.
    """
    steps = rows.withColumns({"__text": normalize_description(description), "__cat": resolve_category(category)})
    alias_cat, alias_sub, mismatch = resolve_sub_category(sub_category, F.col("__cat"))
    steps = steps.withColumns({"__mis": mismatch, "__sub": alias_sub, "__cat": F.coalesce("__cat", alias_cat)})
    if dictionary is None:
        with_sub, alone = best_keyword("__text", language, "__cat", True), best_keyword("__text", language, None, False)
    else:
        best = lambda words, hint, name: keyword_matches(steps, words, key, "__text", language, hint).where("rank = 1").select(key, F.struct("keyword", "category", "sub_category").alias(name))
        found_with, found_alone = best(dictionary.where("sub_category is not null"), "__cat", "__best"), best(dictionary.where("sub_category is null"), None, "__alone")
        steps = steps.join(found_with, key, "left").join(found_alone, key, "left")
        with_sub, alone = F.col("__best"), F.col("__alone")
    steps = steps.withColumn("__kw", F.when(F.col("__sub").isNull(), with_sub))
    steps = steps.withColumn("__only", F.when(F.col("__cat").isNull() & F.col("__kw").isNull(), alone))
    had = F.col("__cat").isNotNull()
    found = F.coalesce("__cat", "__kw.category", "__only.category", F.lit(UNKNOWN))
    given = resolve_category(category).isNotNull()
    source = F.when(F.col("__sub").isNotNull(), F.when(had, "explicit").otherwise("explicit_sub_category")).when(F.col("__kw").isNotNull() & given, "explicit_category+inferred_sub_category").when(F.col("__kw").isNotNull(), "inferred").when(found != UNKNOWN, "category_only").otherwise("fallback")
    out = steps.withColumn("norm_source", source)
    out = out.withColumns({"norm_category": found, "norm_sub_category": F.coalesce("__sub", "__kw.sub_category", F.lit(UNCLASSIFIED)), "norm_confidence": lookup("norm_source", SOURCES), "norm_keyword": F.coalesce("__kw.keyword", "__only.keyword"), "norm_mismatch": F.coalesce("__mis", F.lit(False))})
    return out.drop("__text", "__cat", "__mis", "__sub", "__kw", "__only", "__best", "__alone")


def sector_for(category: str) -> Column:
    """The category as a sector, if it is one."""
    return F.when(F.col(category).isin(*SECTORS), F.col(category)).otherwise(UNKNOWN)


def groupable(category: str, sub_category: str) -> Column:
    """If a record can join an issue group: its category is allowed and its sub-category known."""
    return F.coalesce(F.col(category).isin(*SECTORS) & (F.col(sub_category) != UNCLASSIFIED), F.lit(False))
