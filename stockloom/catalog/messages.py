"""Message queries.  The conversations are invented prose, so most rules use its own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.demand import TABLE
from stockloom.catalog.registry import query
from stockloom.catalog.views import SALES
from stockloom.functions import word_lists as words
from stockloom.operators import demand as d
from stockloom.operators import messages as ms

# Stand-ins for the marker words, taken from the prose.
_MARATHI, _HINGLISH = ["der", "und"], ["the", "of", "that"]
_INTENTS = {
    "STOCKOUT_INVENTORY": ["that ", "nicht"],
    "ANOMALY_ALERTS": ["ment", "ción"],
    "FORECAST_INQUIRY": ["with", "sch"],
    "SALES_REVENUE": ["que", "ing"],
}
_CITIES = {"the": "Delhi", "der": "Mumbai", "ción": "Bengaluru", "que": "Delhi", "ing": "HR-NCR"}


def _word(terms):
    return "(^|[^\\p{L}\\p{N}_])(" + "|".join(terms) + ")([^\\p{L}\\p{N}_]|$)"


def _alternatives(phrases):
    return "|".join(phrases)


@query(
    "txt01_language",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hindi' WHEN regexp_matches(lower(text), '{_word(_MARATHI)}') THEN 'marathi'
    WHEN regexp_matches(lower(text), '{_word(_HINGLISH)}') THEN 'hinglish' ELSE 'english' END AS language FROM conversations""",
)
def _(t):
    rows = ms.tag_language(t.read("conversations"), marathi_latin=_MARATHI, hinglish=_HINGLISH)
    return rows.select("conv_id", "turn", "language")


_INTENT_SQL = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(lower(text), '{_alternatives(p)}') THEN '{name}'" for name, p in _INTENTS.items())
    + " ELSE 'GENERAL_INTELLIGENCE' END"
)


@query("txt02_intent", f"SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM conversations")
def _(t):
    return ms.tag_intent(t.read("conversations"), rules=_INTENTS).select("conv_id", "turn", "intent")


def _phrases(phrases):
    return "|".join(ms.quote_literal(p) for p in phrases).replace("'", "''")


def _business_sql() -> str:
    plain = [w for w in words.FOLLOW_UPS if not w.endswith("?")]
    follow = (
        f"(regexp_matches(lower(text), '{_word(plain)}')"
        " OR len([w FOR w IN regexp_split_to_array(lower(text), '\\s+') IF w <> '']) <= 4)"
    )
    cases = []
    for name, phrases in words.BUSINESS_INTENTS.items():
        condition = f"regexp_matches(lower(text), '{_phrases(phrases)}')"
        if name == "why_inquiry":
            condition = f"(regexp_matches(lower(text), '{words.BARE_WHY}') OR ({follow} AND {condition}))"
        elif name == "city_performance":
            condition += " AND NOT regexp_matches(lower(text), 'product|sku')"
        cases.append(f"WHEN {condition} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{words.DEFAULT_BUSINESS_INTENT}' END"


@query("txt02_business_intent", f"SELECT conv_id, turn, {_business_sql()} AS intent FROM conversations")
def _(t):
    return ms.tag_business_intent(t.read("conversations")).select("conv_id", "turn", "intent")


def _city_sql(text):
    cases = ", ".join(f"CASE WHEN contains(lower({text}), '{k}') OR contains({text}, '{k}') THEN '{v}' END" for k, v in _CITIES.items())
    return f"[x FOR x IN [{cases}] IF x IS NOT NULL]"


@query(
    "txt03_numbers",
    """SELECT doc_id, array_to_string([x FOR x IN regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+') IF regexp_full_match(x, '[0-9]{3,7}')], ',') AS skus,
    CASE WHEN contains(lower(text), 'the') THEN 'Delhi' ELSE '' END AS cities FROM documents""",
)
def _(t):
    rows = ms.extract_numbers(t.read("documents"), synonyms={"the": "Delhi"})
    return rows.select("doc_id", F.array_join("skus", ",").alias("skus"), F.array_join("cities", ",").alias("cities"))


@query(
    "txt03_entities",
    f"""WITH x AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+') IF regexp_full_match(x, '[0-9]{{4,6}}')] AS free,
      regexp_extract_all(text, '(?i)(?:sku|product|item|id)\\s*#?\\s*([0-9]{{1,7}})\\b', 1) AS named, {_city_sql('text')} AS c FROM documents)
    SELECT doc_id, array_to_string([CAST(CAST(v AS BIGINT) AS VARCHAR) FOR v IN CASE WHEN len(named) > 0 THEN named ELSE free END][1:5], ',') AS product_ids,
    array_to_string([v FOR v, i IN c IF list_position(c, v) = i][1:4], ',') AS cities FROM x""",
)
def _(t):
    rows = ms.extract_entities(t.read("documents"), synonyms=_CITIES)
    return rows.select(
        "doc_id", F.array_join(F.transform("product_ids", lambda x: x.cast("string")), ",").alias("product_ids"), F.array_join("cities", ",").alias("cities")
    )


_CONTEXT = f"""found AS (SELECT conv_id, turn, TRY_CAST(COALESCE(NULLIF(regexp_extract(text, '(?i)(?:product\\s*id:?|sku\\s*#?|product\\s*#?)\\s*([0-9]{{1,7}})\\b', 1), ''),
      [x FOR x IN regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+') IF regexp_full_match(x, '[0-9]{{4,6}}')][1]) AS BIGINT) AS product_id,
    {_city_sql('text')}[1] AS city, CASE WHEN role = 'assistant' THEN {_INTENT_SQL} END AS intent FROM conversations),
  held AS (SELECT conv_id, turn, LAST_VALUE(product_id IGNORE NULLS) OVER w AS current_product_id, LAST_VALUE(city IGNORE NULLS) OVER w AS current_city,
    LAST_VALUE(intent IGNORE NULLS) OVER w AS current_intent, LAST_VALUE(CASE WHEN product_id IS NOT NULL THEN turn END IGNORE NULLS) OVER w AS pt,
    LAST_VALUE(CASE WHEN city IS NOT NULL THEN turn END IGNORE NULLS) OVER w AS ct, LAST_VALUE(CASE WHEN intent IS NOT NULL THEN turn END IGNORE NULLS) OVER w AS it
    FROM found WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "txt04_carry_context",
    f"""WITH {_CONTEXT} SELECT conv_id, turn, current_product_id, current_city,
    CASE WHEN pt IS NULL OR ct IS NULL OR it >= least(pt, ct) THEN current_intent END AS current_intent FROM held""",
)
def _(t):
    rows = ms.conversation_context(t.read("conversations"), synonyms=_CITIES, intents=_INTENTS)
    return rows.select("conv_id", "turn", "current_product_id", "current_city", "current_intent")


@query(
    "txt04_follow_up",
    f"""SELECT conv_id, turn, regexp_matches(lower(text), '{_word(["it", "der", "que"])}') OR len([w FOR w IN regexp_split_to_array(lower(text), '\\s+') IF w <> '']) <= 4 AS is_follow_up FROM conversations""",
)
def _(t):
    return t.read("conversations").select("conv_id", "turn", ms.is_follow_up("text", ["it", "der", "que"]).alias("is_follow_up"))


@query(
    "txt05_retrieve",
    f"""WITH {SALES}, {TABLE}, tagged AS (SELECT conv_id, turn, {_INTENT_SQL} AS intent, CASE turn % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'ALL' END AS city FROM conversations),
    mv AS (SELECT product_id, city_name, SUM(total_quantity) AS q FROM demand GROUP BY 1, 2), rv AS (SELECT product_id, city_name, CAST(SUM(order_count) AS BIGINT) AS q FROM demand GROUP BY 1, 2),
    e AS (SELECT 'SALES_REVENUE' AS intent, city_name AS city, product_id, city_name, q FROM mv UNION ALL SELECT 'SALES_REVENUE', 'ALL', product_id, city_name, q FROM mv
      UNION ALL SELECT 'STOCKOUT_INVENTORY', city_name, product_id, city_name, CAST(q AS DOUBLE) FROM rv UNION ALL SELECT 'STOCKOUT_INVENTORY', 'ALL', product_id, city_name, CAST(q AS DOUBLE) FROM rv),
    j AS (SELECT *, CASE intent WHEN 'SALES_REVENUE' THEN '{{"product_id":' || product_id || ',"city_name":"' || city_name || '","total_quantity":' || CAST(q AS VARCHAR) || '}}'
      ELSE '{{"product_id":' || product_id || ',"city_name":"' || city_name || '","orders":' || CAST(CAST(q AS BIGINT) AS VARCHAR) || '}}' END AS evidence FROM e),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY intent, city ORDER BY q DESC, evidence) AS place FROM j)
    SELECT t.conv_id, t.turn, t.intent, t.city, CAST(place AS INTEGER) AS place, evidence FROM tagged t JOIN k ON t.intent = k.intent AND t.city = k.city
    WHERE place <= CASE t.intent WHEN 'SALES_REVENUE' THEN 5 ELSE 3 END""",
)
def _(t):
    place = F.when(F.col("turn") % 3 == 0, "ASIA").when(F.col("turn") % 3 == 1, "EUROPE")
    tagged = ms.tag_intent(t.read("conversations"), rules=_INTENTS).select("conv_id", "turn", "intent", place.alias("city"))
    series = d.demand_table(t.sales).groupBy("product_id", "city_name")
    figures = {
        "SALES_REVENUE": (series.agg(F.sum("total_quantity").alias("total_quantity")), "total_quantity", 5),
        "STOCKOUT_INVENTORY": (series.agg(F.sum("order_count").alias("orders")), "orders", 3),
    }
    return ms.retrieve(tagged, figures)


_REGIONS = {"der": "EUROPE", "que": "AFRICA", "sch": "ASIA"}
_REGIONS_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in _REGIONS.items())


@query(
    "txt05_evidence",
    f"""WITH {SALES}, {TABLE}, f AS (SELECT product_id, city_name, SUM(total_quantity) AS q, SUM(order_count) AS o, MAX(total_quantity) AS m, COUNT(*) AS n FROM demand GROUP BY 1, 2),
    s AS (SELECT 'inventory' AS kind, 5 AS most, product_id, city_name, CAST(o AS DOUBLE) AS value FROM f UNION ALL SELECT 'anomaly', 5, product_id, city_name, CAST(m AS DOUBLE) FROM f
      UNION ALL SELECT 'forecast', 6, product_id, city_name, CAST(n AS DOUBLE) FROM f UNION ALL SELECT 'sales', 5, product_id, city_name, CAST(q AS DOUBLE) FROM f),
    said AS (SELECT conv_id, turn, {_INTENT_SQL} AS intent, list_sort(list_distinct([x FOR x IN [{_REGIONS_SQL}] IF x IS NOT NULL])) AS cities,
      list_sort(list_distinct([CAST(x AS BIGINT) FOR x IN regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+') IF regexp_full_match(x, '[0-9]{{3,7}}')])) AS ids FROM conversations),
    asked AS (SELECT DISTINCT intent, ids, cities FROM said),
    met AS (SELECT intent, ids, cities, kind, most, product_id, city_name, value,
      ROW_NUMBER() OVER (PARTITION BY intent, ids, cities, kind ORDER BY value DESC, product_id, city_name) AS place
      FROM asked JOIN s ON (len(ids) = 0 OR kind = 'sales' OR list_contains(ids, product_id)) AND (len(cities) = 0 OR list_contains(cities, city_name))
      WHERE kind = 'sales' OR (kind = 'inventory' AND (intent = 'STOCKOUT_INVENTORY' OR len(ids) > 0)) OR (kind = 'anomaly' AND intent = 'ANOMALY_ALERTS')
        OR (kind = 'forecast' AND intent IN ('FORECAST_INQUIRY', 'STOCKOUT_INVENTORY'))),
    best AS (SELECT *, SUM(CASE WHEN kind IN ('inventory', 'anomaly') THEN 1 ELSE 0 END) OVER (PARTITION BY intent, ids, cities) AS early FROM met WHERE place <= most),
    kept AS (SELECT * FROM best WHERE kind <> 'forecast' OR intent = 'FORECAST_INQUIRY' OR early < 2),
    final AS (SELECT *, SUM(CASE WHEN kind <> 'sales' THEN 1 ELSE 0 END) OVER (PARTITION BY intent, ids, cities) AS others FROM kept)
    SELECT conv_id, turn, intent, array_to_string(cities, ',') AS cities, kind, CAST(place AS INTEGER) AS place, product_id, city_name, value
    FROM said JOIN final USING (intent, ids, cities) WHERE kind <> 'sales' OR intent IN ('SALES_REVENUE', 'GENERAL_INTELLIGENCE') OR others < 1""",
)
def _(t):
    said = ms.extract_numbers(ms.tag_intent(t.read("conversations"), rules=_INTENTS), synonyms=_REGIONS)
    said = said.select("conv_id", "turn", "intent", F.col("skus").cast("array<bigint>").alias("product_ids"), "cities")
    figures = d.demand_table(t.sales).groupBy("product_id", "city_name")
    figures = ms.materialize(
        figures.agg(
            F.sum("total_quantity").alias("quantity"), F.sum("order_count").alias("orders"),
            F.max("total_quantity").alias("peak"), F.count(F.lit(1)).alias("days"),
        )
    )
    sources = {
        "inventory": ms.Source(figures, "orders", 5, ("STOCKOUT_INVENTORY",), named=True),
        "anomaly": ms.Source(figures, "peak", 5, ("ANOMALY_ALERTS",)),
        "forecast": ms.Source(figures, "days", 6, ("FORECAST_INQUIRY",), below=2, fill=("STOCKOUT_INVENTORY",)),
        "sales": ms.Source(figures, "quantity", 5, ("SALES_REVENUE", "GENERAL_INTELLIGENCE"), by_product=False, below=1),
    }
    rows = ms.evidence(said, sources)
    return rows.withColumn("cities", F.array_join("cities", ",")).drop("product_ids")


@query(
    "txt06_citations",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS citation_count, CASE WHEN event_id % 5 <> 0 THEN event_type END AS first_type,
    CASE WHEN event_id % 5 <> 0 THEN user_id END AS first_product FROM events""",
)
def _(t):
    context = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("broken "), F.col("props"))).otherwise(
        F.to_json(
            F.struct(
                F.array(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("product_id"))).alias("citations")
            )
        )
    )
    rows = ms.parse_citations(t.read("events").select("event_id", context.alias("retrieved_context")))
    return rows.select(
        "event_id",
        F.size("citations").alias("citation_count"),
        F.get("citations", 0)["type"].alias("first_type"),
        F.get("citations", 0)["product_id"].alias("first_product"),
    )
