"""Tagging, context and evidence for tables of business questions.

All rules are column expressions over the message text, so a message table of
any size is tagged in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import word_lists as words
from stockloom.functions.running import carry_last
from stockloom.session import materialize

# Evidence tables of at most this many rows are sent to the messages.
BROADCAST_ROWS = 100_000


def quote_literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def has_word(c: Column, terms: list[str]) -> Column:
    """Does the text contain one of the terms as whole words?"""
    return c.rlike(r"(?U)\b(?:" + "|".join(quote_literal(w) for w in terms) + r")\b")


def has_phrase(c: Column, phrases: list[str]) -> Column:
    """Does the text contain one of the phrases anywhere?"""
    return c.rlike("|".join(quote_literal(p) for p in phrases))


def tag_language(
    df: DataFrame,
    text: str = "text",
    marathi: list[str] = words.MARATHI_MARKERS,
    marathi_latin: list[str] = words.MARATHI_LATIN,
    hinglish: list[str] = words.HINGLISH,
) -> DataFrame:
    """marathi, hindi, hinglish or english by script and marker words."""
    message = F.col(text)
    devanagari = message.rlike("[\\u0900-\\u097F]")
    lower = F.lower(message)
    return df.withColumn(
        "language",
        F.when(devanagari & has_phrase(message, marathi), "marathi")
        .when(devanagari, "hindi")
        .when(has_word(lower, marathi_latin), "marathi")
        .when(has_word(lower, hinglish), "hinglish")
        .otherwise("english"),
    )


def tag_intent(
    df: DataFrame, text: str = "text", rules: dict[str, list[str]] = words.INTENTS, default: str = words.DEFAULT_INTENT
) -> DataFrame:
    """First rule with a contained phrase decides."""
    lower = F.lower(F.col(text))
    label = F.lit(default)
    for name, phrases in reversed(list(rules.items())):
        label = F.when(has_phrase(lower, phrases), F.lit(name)).otherwise(label)
    return df.withColumn("intent", label)


def is_follow_up(text: str = "text", triggers: list[str] = words.FOLLOW_UPS) -> Column:
    """A short message, or one that points back to an earlier one."""
    lower = F.lower(F.col(text))
    bare = [w for w in triggers if not w.endswith("?")]
    asked = [w for w in triggers if w.endswith("?")]
    matched = has_word(lower, bare)
    if asked:
        # A word boundary after "?" needs a word character right behind it.
        matched = matched | lower.rlike(r"(?U)\b(?:" + "|".join(quote_literal(w) for w in asked) + r")\b")
    tokens = F.filter(F.split(lower, r"\s+"), lambda w: w != "")
    return matched | (F.size(tokens) <= 4)


def tag_business_intent(df: DataFrame, text: str = "text", context_intent: str | None = None) -> DataFrame:
    """The detailed intent classes.

    "why" counts only alone or in a follow-up; city questions must not name a
    product; without any match a follow-up keeps the intent in the column
    ``context_intent``.
    """
    lower = F.lower(F.col(text))
    follow_up = is_follow_up(text)
    label = F.lit(words.DEFAULT_BUSINESS_INTENT)
    if context_intent is not None:
        label = F.when(follow_up & F.col(context_intent).isNotNull(), F.col(context_intent)).otherwise(label)
    for name, phrases in reversed(list(words.BUSINESS_INTENTS.items())):
        matched = has_phrase(lower, phrases)
        if name == "why_inquiry":
            matched = lower.rlike(words.BARE_WHY) | (follow_up & matched)
        elif name == "city_performance":
            matched = matched & ~has_phrase(lower, ["product", "sku"])
        label = F.when(matched, F.lit(name)).otherwise(label)
    return df.withColumn("intent", label)


def _cities(message: Column, synonyms: dict[str, str]) -> Column:
    lower = F.lower(message)
    found = [
        F.when(lower.contains(term) | message.contains(term), F.lit(city)) for term, city in synonyms.items()
    ]
    return F.array_distinct(F.array_compact(F.array(*found)))


def extract_numbers(df: DataFrame, text: str = "text", synonyms: dict[str, str] = words.HUBS) -> DataFrame:
    """Product numbers (3 to 7 digits) and cities named in the message."""
    skus = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\b[0-9]{3,7}\b)"), F.lit(1))
    return df.withColumns({"skus": skus, "cities": _cities(F.col(text), synonyms)})


def extract_entities(
    df: DataFrame,
    text: str = "text",
    synonyms: dict[str, str] = words.CITY_SYNONYMS,
    max_products: int = 5,
    max_cities: int = 4,
) -> DataFrame:
    """Named product ids, else free-standing 4 to 6 digit numbers; and cities."""
    message = F.col(text)
    named = F.regexp_extract_all(message, F.lit(r"(?iU)(?:sku|product|item|id)\s*#?\s*([0-9]{1,7})\b"), F.lit(1))
    free = F.regexp_extract_all(message, F.lit(r"(?U)\b([0-9]{4,6})\b"), F.lit(1))
    ids = F.transform(F.when(F.size(named) > 0, named).otherwise(free), lambda x: x.cast("bigint"))
    return df.withColumns(
        {
            "product_ids": F.slice(ids, 1, max_products),
            "cities": F.slice(_cities(message, synonyms), 1, max_cities),
        }
    )


def carry_context(
    df: DataFrame,
    columns: list[str],
    conversation: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
) -> DataFrame:
    """For each turn the last earlier product, city or intent, and a follow-up mark."""
    carried = carry_last(df, [conversation], turn, {f"current_{c}": c for c in columns})
    return carried.withColumn("is_follow_up", is_follow_up(text))


# How earlier turns name a product and an assistant names a quantity.
_TURN_PRODUCT = r"(?iU)(?:product\s*id:?|sku\s*#?|product\s*#?)\s*([0-9]{1,7})\b"
_TURN_QUANTITY = (
    r"(?i)(?:order\s*quantity|recommended\s*order|reorder\s*qty|order\s*qty|प्रमाण|ऑर्डर|quantity)"
    r"[^0-9]*([0-9,]+(?:\.[0-9]+)?)\s*units?"
)


def turn_facts(
    df: DataFrame,
    text: str = "text",
    role: str = "role",
    turn: str = "turn",
    synonyms: dict[str, str] = words.HUBS,
    intents: dict[str, list[str]] | None = None,
) -> DataFrame:
    """What each turn itself says: product, city, and of assistants quantity and intent.

    Every fact comes with the turn it stands in, for ``conversation_context``.
    """
    message, assistant = F.col(text), F.col(role) == "assistant"

    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))

    named = F.coalesce(first(_TURN_PRODUCT), first(r"(?U)\b([0-9]{4,6})\b")).try_cast("bigint")
    amount = F.translate(first(_TURN_QUANTITY), ",", "").try_cast("double")
    tagged = tag_intent(df, text=text, rules=intents) if intents else tag_intent(df, text=text)
    facts = {
        "product_id": named,
        "city": F.get(_cities(message, synonyms), F.lit(0)),
        "order_qty": F.when(assistant & (amount > 0), amount),
        "intent": F.when(assistant, F.col("intent")),
    }
    found = tagged.withColumns(facts)
    return found.withColumns({f"{c}_turn": F.when(F.col(c).isNotNull(), F.col(turn)) for c in facts})


def conversation_context(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", **options
) -> DataFrame:
    """Each turn with the last product, city, quantity and intent of the turns before it.

    Earlier turns are read backwards until product and city are known; quantity and
    intent from before that point do not count.
    """
    facts = ["product_id", "city", "order_qty", "intent"]
    found = turn_facts(df, text=text, turn=turn, **options)
    columns = {f"current_{c}": c for c in facts} | {f"_at_{c}": f"{c}_turn" for c in facts}
    carried = carry_last(found, [conversation], turn, columns)
    both = F.col("_at_product_id").isNotNull() & F.col("_at_city").isNotNull()
    stop = F.when(both, F.least("_at_product_id", "_at_city"))
    late = {
        f"current_{c}": F.when(stop.isNull() | (F.col(f"_at_{c}") >= stop), F.col(f"current_{c}"))
        for c in ("order_qty", "intent")
    }
    return carried.withColumns(late).drop(*[f"_at_{c}" for c in facts], *[f"{c}_turn" for c in facts])


def fill_from_context(df: DataFrame, text: str = "text", synonyms: dict[str, str] = words.CITY_SYNONYMS) -> DataFrame:
    """Entities of the message itself, else those carried by ``conversation_context``."""
    own = extract_entities(df, text, synonyms)
    return own.withColumns(
        {
            name: F.when(F.size(name) > 0, F.col(name)).otherwise(F.array_compact(F.array(carried)))
            for name, carried in (("product_ids", "current_product_id"), ("cities", "current_city"))
        }
    )


def top_evidence(table: DataFrame, intent: str, order: str, n: int) -> DataFrame:
    """The ``n`` best rows of a figure table, per city and over all cities.

    Columns: intent, city, place, evidence (JSON).  Rows beyond the n-th of a
    city are cut before the shuffle.
    """
    cities = F.explode(F.array(F.lit("ALL"), F.col("city_name"))).alias("city")
    rows = table.select(cities, F.col(order).alias("_v"), F.struct(*table.columns).alias("_row"))
    best = rows.withColumn("_rank", F.rank().over(Window.partitionBy("city").orderBy(F.desc("_v"))))
    # JSON is built for the best rows and their ties only.
    best = best.where(F.col("_rank") <= n).withColumn("evidence", F.to_json("_row"))
    place = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("_v"), "evidence"))
    return (
        best.withColumn("place", place)
        .where(F.col("place") <= n)
        .select(F.lit(intent).alias("intent"), "city", "place", "evidence")
    )


def retrieve(messages: DataFrame, figures: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """Evidence rows for tagged messages.

    ``figures`` maps an intent to (table with city_name, ranking column, rows
    wanted).  The best rows are prepared once per city; messages only join.
    ``messages`` has ``intent`` and ``city`` (null means all cities).  There are at
    most intents x cities x n prepared rows; while they number at most
    ``BROADCAST_ROWS`` they travel to the messages, which are then not shuffled.
    """
    parts = [top_evidence(table, intent, order, n) for intent, (table, order, n) in figures.items()]
    prepared = parts[0]
    for part in parts[1:]:
        prepared = prepared.unionByName(part)
    asked = messages.withColumn("city", F.coalesce("city", F.lit("ALL")))
    prepared = materialize(prepared)
    if prepared.count() <= BROADCAST_ROWS:
        prepared = F.broadcast(prepared)
    return asked.join(prepared, ["intent", "city"])


@dataclass(frozen=True)
class Source:
    """A figure table (product_id, city_name, ``order``) that can answer messages.

    It is asked by ``intents``, by messages that name a product if ``named``, and, while
    the sources before it gave fewer than ``below`` rows, by ``fill`` (None: all intents).
    ``by_product`` tells whether named products narrow its rows.
    """

    table: DataFrame
    order: str
    n: int
    intents: tuple[str, ...]
    by_product: bool = True
    named: bool = False
    below: int = 0
    fill: tuple[str, ...] | None = None


def evidence(messages: DataFrame, sources: dict[str, Source]) -> DataFrame:
    """Columns of ``messages`` with kind, place, product_id, city_name and value of each answer.

    ``messages`` has intent, product_ids and cities (null or empty: any).  Equal requests
    are answered once.  The best rows are prepared per product or all and city or all,
    cut before the shuffle, so a request meets at most products x cities x n rows.
    Messages without any answer give no row; repeated messages come as often as they are.
    """
    key = ["intent", "product_ids", "cities"]
    lists = {"product_ids": F.expr("cast(array() as array<bigint>)"), "cities": F.expr("cast(array() as array<string>)")}
    asked = messages.withColumns(
        {c: F.sort_array(F.array_distinct(F.array_compact(F.coalesce(c, none)))) for c, none in lists.items()}
    )
    requests = materialize(asked.select(*key).distinct())
    answers = ["product_id", "city_name", "value"]
    best_first = [F.desc("value"), "product_id", "city_name"]
    found, kinds = None, list(sources)
    for number, (kind, source) in enumerate(sources.items()):
        products = F.array(F.lit(""), F.col("product_id").cast("string")) if source.by_product else F.array(F.lit(""))
        prepared = (
            source.table.select("product_id", "city_name", F.col(source.order).cast("double").alias("value"))
            .select(*answers, F.explode(products).alias("at_product"))
            .select("*", F.explode(F.array(F.lit(""), "city_name")).alias("at_city"))
            .withColumn("_k", F.row_number().over(Window.partitionBy("at_product", "at_city").orderBy(*best_first)))
            .where(F.col("_k") <= source.n)
            .drop("_k")
        )
        wanted = F.col("intent").isin(*source.intents)
        if source.named:
            wanted = wanted | (F.size("product_ids") > 0)
        if source.below:
            wanted = F.lit(True) if source.fill is None else wanted | F.col("intent").isin(*source.fill)
        any_of = F.array(F.lit(""))
        at = F.col("product_ids").cast("array<string>")
        narrowed = F.when(F.size(at) > 0, at).otherwise(any_of) if source.by_product else any_of
        lookups = (
            requests.where(wanted)
            .select(*key, F.explode(narrowed).alias("at_product"))
            .select("*", F.explode(F.when(F.size("cities") > 0, F.col("cities")).otherwise(any_of)).alias("at_city"))
        )
        part = lookups.join(prepared, ["at_product", "at_city"]).select(*key, F.lit(number).alias("_kind"), *answers)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy(*key, "_kind").orderBy(*best_first))
    limits = F.element_at(F.array(*[F.lit(s.n) for s in sources.values()]), F.col("_kind") + 1)
    found = found.withColumn("place", place).where(F.col("place") <= limits)
    for number, source in enumerate(sources.values()):
        if source.below:
            before = F.sum((F.col("_kind") < number).cast("int")).over(Window.partitionBy(*key))
            own = F.col("intent").isin(*source.intents)
            if source.named:
                own = own | (F.size("product_ids") > 0)
            found = found.withColumn("_before", before).where(
                (F.col("_kind") != number) | own | (F.col("_before") < source.below)
            )
    names = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("_kind") + 1)
    return asked.join(found.select(*key, names.alias("kind"), "place", *answers), key)


CITATION_SCHEMA = "citations array<struct<type: string, title: string, product_id: bigint, city: string>>"


def parse_citations(df: DataFrame, column: str = "retrieved_context") -> DataFrame:
    """Citations of the stored JSON context; unreadable context gives none."""
    parsed = F.from_json(column, CITATION_SCHEMA)["citations"]
    return df.withColumn("citations", F.coalesce(parsed, F.expr("cast(array() as array<struct<type: string, title: string, product_id: bigint, city: string>>)")))
