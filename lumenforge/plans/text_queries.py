"""Text: cues, categories, tags, token similarity, pages, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from .atoms import pick, pick_sql
from .registry import Tables, query


@query("""SELECT doc_id, CASE WHEN starts_with(lower(source), 'src1') THEN 'instructional' WHEN lower(lang) = 'de' THEN 'commentary' WHEN lower(source) = 'src2' THEN 'negative' ELSE 'witnessed' END AS family FROM documents""")
def query_family(t: Tables) -> DataFrame:
    src = F.when(F.col("lang") == "de", "commentary").when(F.col("source") == "src2", "null").otherwise(F.col("source"))
    cat = F.when(F.col("source").startswith("src1"), F.concat(F.lit("instr_"), F.col("source"))).otherwise("")
    return t.documents.select("doc_id", text.query_family(src, cat).alias("family"))


BLOCKED = ["the the", "thing", "ation"]


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'the the') THEN 'blocked_theme:the the' WHEN regexp_matches(lower(text), 'thing') THEN 'blocked_theme:thing' WHEN regexp_matches(lower(text), 'ation') THEN 'blocked_theme:ation' END AS reason FROM documents")
def policy_reason(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.policy_reason(F.col("text"), BLOCKED).alias("reason"))


def _scope_sql(col: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in text.SCOPE_BLOCKS)
    return f"CASE WHEN NOT auto THEN 'not_automatic_expansion' WHEN q = '' THEN 'empty_query' WHEN length(q) > 120 THEN 'query_too_long' {whens} ELSE 'within_ordinary_social_scope' END"


QUERIES = ["police chase", "dog vs cat", "", "queue jumper", "x" * 121, "video game night", "rude neighbour", "car crash compilation"]


@query(f"WITH d AS (SELECT doc_id, source <> 'src0' AS auto, trim(regexp_replace({pick_sql('doc_id', QUERIES, 29)}, '\\s+', ' ', 'g')) AS q FROM documents) SELECT doc_id, {_scope_sql('q')} AS reason FROM d")
def scope_gate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.scope_gate(pick("doc_id", QUERIES, 29), F.col("source") != "src0").alias("reason"))


_CONV = "trim(regexp_replace(text || CASE turn % 5 WHEN 1 THEN ' stop that' WHEN 2 THEN ' are you okay' WHEN 3 THEN ' she said so' WHEN 4 THEN ' how rude' ELSE '' END, '\\s+', ' ', 'g'))"


@query("WITH c AS (SELECT conv_id, turn, lower(" + _CONV + ") AS x FROM conversations) SELECT conv_id, turn, " + ", ".join(f"regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}') AS {n}" for n, p in text.INTERVENTIONS.items()) + " FROM c")
def intervention_features(t: Tables) -> DataFrame:
    """Mechanisms in each turn; the invented texts get a cue appended by turn."""
    extra = F.when(F.col("turn") % 5 == 1, " stop that").when(F.col("turn") % 5 == 2, " are you okay").when(F.col("turn") % 5 == 3, " she said so").when(F.col("turn") % 5 == 4, " how rude").otherwise("")
    cues = text.interventions(F.concat("text", extra))
    return t.conversations.select("conv_id", "turn", *[cues[n].alias(n) for n in text.INTERVENTIONS])


@query("WITH w AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents) SELECT doc_id, CASE WHEN x = '' THEN 'missing' " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in text.NORM_CATEGORIES) + " ELSE 'other_unmapped' END AS category FROM (SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM w)")
def category_first_match(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.norm_category(F.col("text")).alias("category"))


_RANGES = ", ".join(f"struct_pack(s := '{n}', lo := {lo}, hi := {hi})" for n, lo, hi in text.SCRIPTS)
_BANKS = ", ".join("struct_pack(l := '" + n + "', w := [" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "])" for n, ws in text.STOPWORDS.items())
_HALF = "[" + ", ".join(f"'{w}'" for w in text.AMBIGUOUS) + "]"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\p{{L}}') AS ls, list_distinct(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\\p{{L}}''\\s]+', '', 'g')), '\\s+')) AS ws FROM documents),
c AS (SELECT doc_id, ls, ws, list_transform([{_RANGES}], lambda r: struct_pack(s := r.s, n := len(list_filter(ls, lambda x: unicode(x) BETWEEN r.lo AND r.hi)))) AS ns FROM d),
m AS (SELECT doc_id, ls, ws, ns, len(ls) - list_sum(list_transform(ns, lambda x: x.n)) AS latin, list_max(list_transform(ns, lambda x: x.n)) AS most FROM c),
v AS (SELECT doc_id, unnest([{_BANKS}]) AS b, ws FROM d), x AS (SELECT doc_id, b.l AS l, len(list_intersect(b.w, ws)) - 0.5 * len(list_intersect(list_intersect(b.w, ws), {_HALF})) AS n FROM v), k AS (SELECT doc_id, list(struct_pack(n := n, l := l) ORDER BY n DESC, l DESC) AS r FROM x GROUP BY doc_id)
SELECT m.doc_id, CASE WHEN len(ls) < 6 THEN 'too_short' WHEN latin >= most THEN CASE WHEN r[1].n >= 1.5 AND r[1].n > r[2].n THEN r[1].l ELSE 'unknown_latin' END ELSE 'script:' || list_filter(ns, lambda x: x.n = most)[1].s END AS language, CASE WHEN len(ls) < 6 THEN 0.0 ELSE round(greatest(latin, most) / len(ls), 3) END AS script_fraction FROM m JOIN k ON m.doc_id = k.doc_id""")
def script_language_tag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.language_tag(F.col("text")).alias("x")).select("doc_id", "x.*")


@query("""WITH p AS (SELECT unnest(['the and', 'on the', 'of the', 'is the']) AS phrase, unnest([1, 2, 3, 3]) AS tier) SELECT conv_id, turn, tier, phrase, CAST(len(regexp_extract_all(lower(text), '(?:^|[^a-z])' || phrase || '(?:[^a-z]|$)')) AS BIGINT) AS hits FROM conversations JOIN p ON regexp_matches(lower(text), '(?:^|[^a-z])' || phrase || '(?:[^a-z]|$)')""")
def phrase_detect_tiers(t: Tables) -> DataFrame:
    """Phrases by tier; one pass over the text for all, no join with the phrases."""
    bank = [("the and", 1), ("on the", 2), ("of the", 3), ("is the", 3)]
    hit = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("tier"), F.regexp_count(F.lower("text"), F.lit(f"(?:^|[^a-z]){p}(?:[^a-z]|$)")).cast("long").alias("hits")) for p, n in bank])
    return t.conversations.select("conv_id", "turn", F.explode(F.filter(hit, lambda x: x["hits"] > 0)).alias("h")).select("conv_id", "turn", "h.tier", "h.phrase", "h.hits")


@query("""WITH a AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS ts FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS ts FROM documents)
 SELECT item_id AS ka, doc_id AS kb, round(len(list_intersect(a.ts, d.ts))::DOUBLE / len(list_distinct(list_concat(a.ts, d.ts))), 6) AS jaccard FROM a JOIN d ON len(a.ts) > 0 AND len(d.ts) > 0 AND len(list_intersect(a.ts, d.ts))::DOUBLE / len(list_distinct(list_concat(a.ts, d.ts))) >= 0.3""")
def token_jaccard_pairs(t: Tables) -> DataFrame:
    toks = lambda d, k: d.select(k, text.tokens(F.col("text"), 5).alias("ts"))
    j = relational.near_items(toks(t.benchmark, "item_id"), toks(t.documents, "doc_id"), "item_id", "doc_id", "ts", 0.3)
    return j.select(F.col("item_id").alias("ka"), F.col("doc_id").alias("kb"), F.round("jaccard", 6).alias("jaccard"))


@query("SELECT page_id, h AS href, CAST(ordinality AS BIGINT) AS place FROM (SELECT page_id, unnest(list_distinct_ordered) AS h, generate_subscripts(list_distinct_ordered, 1) - 1 AS ordinality FROM (SELECT page_id, list_filter(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1), lambda x, i: list_position(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1), x) = i) AS list_distinct_ordered FROM pages))")
def page_hrefs(t: Tables) -> DataFrame:
    """Links of a page in order, the first of equal ones."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1))
    return t.pages.select("page_id", F.posexplode(links).alias("place", "href")).select("page_id", "href", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS q FROM documents")
def normalised_query(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalise_query(F.col("text")).alias("q"))


@query("""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM documents), c AS (SELECT source, t, count(*) AS n FROM w WHERE t NOT IN ('the', 'and') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, t) AS k FROM c) SELECT source, t AS token, n FROM r WHERE k <= 5""")
def top_title_tokens(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    c = t.documents.select("source", F.explode(text.title_tokens(F.col("text"), ["the", "and"])).alias("token")).groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "token"))).where("k <= 5").drop("k")
