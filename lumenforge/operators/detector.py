"""Detection over words with times: normalised text with spans, phrases by tier, quotes, spans, pauses, model answers in JSON.

Words are an array of structs (word, start, end) of one transcript: as long as a transcript, not as a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as words_
from . import intervals


def offsets(parts: Column, gap: Column) -> Column:
    """Where each of the strings of an array starts if they are joined with `gap` characters between them: one running sum over a batch."""

    def run(parts: pa.Array, gap: pa.Array) -> pa.Array:
        sizes = pc.fill_null(parts.value_lengths(), 0).to_numpy(zero_copy_only=False)
        width = pc.fill_null(pc.utf8_length(parts.flatten()), 0).to_numpy(zero_copy_only=False) + np.repeat(pc.fill_null(gap, 0).to_numpy(zero_copy_only=False), sizes)
        ends = np.concatenate(([0], np.cumsum(width)))
        lists = np.concatenate(([0], np.cumsum(sizes)))
        starts = ends[:-1] - np.repeat(ends[lists[:-1]], sizes)
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(starts, pa.int32()))

    # annotations name Arrow's types, which tells what kind of function it is
    run.__annotations__ = {"parts": pa.Array, "gap": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(parts, gap)


def spanned(words: Column) -> Column:
    """The words that keep letters or digits, with token, and the span (a, b) of the token in the tokens joined by blanks."""
    kept = F.filter(F.transform(words, lambda w: F.struct(w["word"].alias("word"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"), words_.normalise_token(w["word"]).alias("token"))), lambda w: w["token"] != "")
    at = offsets(F.coalesce(kept["token"], F.array().cast("array<string>")), F.lit(1))
    return F.zip_with(kept, at, lambda w, a: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["token"].alias("token"), a.alias("a"), (a + F.length(w["token"])).alias("b")))


def covering(spans: Column, lo: Column, hi: Column) -> Column:
    """The words whose span meets [lo, hi)."""
    return F.filter(spans, lambda w: (w["a"] < hi) & (w["b"] > lo))


def between(text: Column, phrase: Column) -> Column:
    """What stands between the places of a phrase, word by word, in a text."""
    return F.split(text, F.concat(F.lit(r"\b\Q"), phrase, F.lit(r"\E\b")), -1)


def phrases(df: DataFrame, keys: list[str], words: str, bank: list[tuple[str, int, float | None, tuple[int, ...]]], context: float = 5.0) -> DataFrame:
    """Rows (keys, phrase, tier, start, end, context) of the phrases of a bank (phrase, tier, window, tiers) in each transcript.

    A phrase with a window counts only if an unconditional one of the given tiers starts within so many seconds; context
    is the words of `context` seconds before and after.
    """
    d = df.select(*keys, spanned(F.col(words)).alias("__w")).withColumn("__t", F.array_join("__w.token", " "))
    rows = []
    for phrase, tier, window, tiers in bank:
        norm = " ".join(x for x in ("".join(ch for ch in w.lower() if ch.isascii() and (ch.isalnum() or ch == "'")) for w in phrase.split()) if x)
        rows.append(F.struct(F.lit(phrase).alias("phrase"), F.lit(norm).alias("norm"), F.lit(tier).alias("tier"), F.lit(window).cast("double").alias("window"), F.array(*[F.lit(x) for x in tiers]).cast("array<int>").alias("tiers")))
    # one expression over a constant array, however many phrases there are
    here = F.filter(F.array(*rows), lambda p: F.contains(F.col("__t"), p["norm"]))
    d = d.select(*keys, "__w", F.explode(here).alias("p"), "__t").select(*keys, "__w", "p", between(F.col("__t"), F.col("p.norm")).alias("__parts"))
    width = F.length("p.norm")
    places = F.transform(F.slice(F.col("__at"), 2, F.greatest(F.size("__at") - 1, F.lit(0))), lambda x: x - width)
    d = d.withColumn("__at", offsets(F.col("__parts"), width)).select(*keys, "__w", "p", F.explode(places).alias("lo"))
    found = d.withColumn("__c", covering(F.col("__w"), F.col("lo"), F.col("lo") + width)).where(F.size("__c") > 0)
    lo, hi = F.col("__c")[0]["start"], F.element_at("__c", -1)["end"]
    near = F.array_join(F.transform(F.filter("__w", lambda w: (w["end"] >= lo - context) & (w["start"] <= hi + context)), lambda w: F.trim(w["word"])), " ")
    out = found.select(*keys, "p.phrase", "p.tier", "p.window", "p.tiers", lo.alias("start"), hi.alias("end"), near.alias("context"))
    anchors = out.where("window IS NULL").groupBy(*keys).agg(F.collect_list(F.struct("tier", "start")).alias("__a"))
    beside = F.exists("__a", lambda a: F.array_contains(F.col("tiers"), a["tier"]) & (F.abs(a["start"] - F.col("start")) <= F.col("window")))
    return out.join(anchors, keys, "left").where(F.col("window").isNull() | F.coalesce(beside, F.lit(False))).drop("window", "tiers", "__a")


def prefix_at(tokens: Column, quote: Column) -> Column:
    """For each place of the tokens, how many tokens of the quote, from its first, stand there."""
    # a token is compared once for each place and token of the quote; the length grows while it has all up to there
    longest = lambda i: F.aggregate(F.sequence(F.lit(1), F.size(quote)), F.lit(0), lambda n, k: F.when((n == k - 1) & F.coalesce(F.get(tokens, i + k - 2) == F.get(quote, k - 1), F.lit(False)), k).otherwise(n))
    return F.when((F.size(quote) > 0) & (F.size(tokens) > 0), F.transform(F.sequence(F.lit(1), F.size(tokens)), longest)).otherwise(F.array().cast("array<int>"))


def located(prefixes: Column, least: int) -> Column:
    """(length, places from 0) of the longest prefix of at least so many tokens; length 0 and no places if there is none."""
    none = F.struct(F.lit(0).alias("length"), F.array().cast("array<int>").alias("places"))

    def at(p: Column, most: Column) -> Column:
        places = F.filter(F.transform(p, lambda n, i: F.when(n == most, i)), lambda i: i.isNotNull())
        return F.when(most >= least, F.struct(most.alias("length"), places.alias("places"))).otherwise(none)

    # the prefixes and their longest are found once, not again for each place
    return words_.let(prefixes, lambda p: words_.let(F.coalesce(F.array_max(p), F.lit(0)), lambda most: at(p, most)))


def recovered(words: Column, first: Column, first_size: Column, last: Column, last_size: Column, most: float) -> Column:
    """The span from a start quote to an end quote, located as above: the shortest in order up to `most` seconds, and how sure it is."""
    each = F.flatten(F.transform(first["places"], lambda i: F.transform(last["places"], lambda j: F.struct((F.element_at(words, j + last["length"])["end"] - F.element_at(words, i + 1)["start"]).alias("duration"), i.alias("i"), (j + last["length"] - 1).alias("j")))))
    fit = F.filter(each, lambda x: (x["j"] >= x["i"]) & (x["duration"] > 0) & (x["duration"] <= most))
    exact = (first["length"] == first_size) & (last["length"] == last_size) & (first["length"] >= 2) & (last["length"] >= 2)
    one = F.size(fit) == 1
    sure = F.when(F.size(fit) == 0, "unresolved").when(exact & one, "exact_unique").when(exact, "exact_ambiguous").when(one, "prefix_unique").otherwise("prefix_ambiguous")
    return F.struct(sure.alias("confidence"), F.size(fit).alias("candidates"), F.round(F.array_min(fit)["duration"], 3).alias("duration"), F.array_min(fit)["i"].alias("first_word"), F.array_min(fit)["j"].alias("last_word"))


def pseudo_words(text: Column, start: Column, end: Column) -> Column:
    """Words of a segment without times, spread evenly over it; a text without blanks is cut into characters."""
    known = start.isNotNull() & end.isNotNull()
    cut = lambda t: F.when(F.contains(t, F.lit(" ")) | (F.length(t) < 2), F.split(t, " ")).otherwise(F.filter(F.split(t, ""), lambda c: c != ""))

    def timed(units: Column) -> Column:
        step = F.greatest(end - start, F.lit(0.0)) / F.size(units)
        at = lambda i: F.round(F.when(i == F.size(units), end).otherwise(start + i * step), 3)
        return F.transform(units, lambda w, i: F.struct(w.alias("word"), F.round(start + i * step, 3).alias("start"), at(i + 1).alias("end")))

    # a text is squeezed and cut once, not for each of its words
    spoken = words_.let(words_.squeeze(F.coalesce(text, F.lit(""))), lambda t: F.when((t != "") & known, words_.let(cut(t), timed)))
    return F.coalesce(spoken, F.array().cast("array<struct<word:string,start:double,end:double>>"))


ANSWER = "struct<is_target:string,hard_negative_type:string,modality:string,agent:string,reactions:array<struct<quote:string,tag:string>>>"


def model_answer(c: Column) -> Column:
    """A model's answer as a struct: fences are cut off; of JSON that was broken off, the fields that came through, and each complete reaction."""
    bare = F.btrim(c, F.lit(" \n\r\t"))
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, "^```(?:json)?", ""), "(?s)```(?!.*```).*$", "")).otherwise(bare)
    bare = F.btrim(bare, F.lit(" \n\r\t"))
    whole = F.from_json(bare, ANSWER, {"mode": "PERMISSIVE"})
    field = lambda name, other: F.coalesce(F.nullif(F.regexp_extract(bare, rf'"{name}"\s*:\s*"(\w+)"', 1), F.lit("")), F.lit(other)).alias(name)
    tail = F.when(F.contains(bare, F.lit('"reactions"')), F.substring_index(bare, '"reactions"', -1)).otherwise(bare)
    complete = F.filter(F.transform(F.regexp_extract_all(tail, F.lit(r"(\{[^{}]*\})"), 1), lambda o: F.from_json(o, "struct<quote:string,tag:string>")), lambda o: o["quote"].isNotNull())
    saved = F.struct(field("is_target", "no"), field("hard_negative_type", "none"), field("modality", "witnessed"), field("agent", "human"), complete.alias("reactions"))
    return F.when(F.endswith(bare, F.lit("}")) & F.json_array_length(F.concat(F.lit("["), bare, F.lit("]"))).isNotNull(), whole).otherwise(saved)


def grounded(evidence: Column, heard: Column) -> Column:
    """Whether what is given as evidence was said, but for case and white space; "none" is no evidence."""
    norm = lambda x: words_.squeeze(F.lower(F.coalesce(x, F.lit(""))))
    return ~norm(evidence).isin("", "none") & F.contains(norm(heard), norm(evidence))


def reaction_candidates(df: DataFrame, said: str, start: str, end: str, before: float = 5.0, after: float = 3.0) -> DataFrame:
    """Segments with an active mechanism, with the window around each, the mechanisms, and whether it's defence or report."""
    cues = words_.interventions(F.col(said))
    active = F.array_compact(F.array(*[F.when(cues[n], F.lit(n)) for n in words_.ACTIVE]))
    d = df.withColumns({"mechanisms": active, "self_defense": cues["self_defense"], "reported": cues["reported"]}).where(F.size("mechanisms") > 0)
    return d.withColumns({"window_start": F.greatest(F.lit(0.0), F.col(start) - before), "window_end": F.col(end) + after})


def pauses(df: DataFrame, keys: list[str], start: str, end: str, longest: float) -> DataFrame:
    """keys and how many gaps between consecutive words are longer than so many seconds."""
    from pyspark.sql import Window as W

    gap = F.lead(start).over(W.partitionBy(*keys).orderBy(start, end)) - F.col(end)
    return df.select(*keys, gap.alias("__gap")).groupBy(*keys).agg(F.count_if(F.col("__gap") > longest).alias("pauses"))


def located_scenes(df: DataFrame, keys: list[str], order: str, said: str, start: str, end: str, deixis: str, action: str, pad: float = 2.0) -> DataFrame:
    """Segments that point at a picture, with the actions named in them or their neighbours (pointing words cut out first) and their bounds."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order)
    hood = w.rowsBetween(-1, 1)
    d = df.withColumns({"__said": F.concat_ws(" ", F.collect_list(F.coalesce(F.col(said), F.lit(""))).over(hood)), "__lo": F.min(start).over(hood), "__hi": F.max(end).over(hood)})
    bare = F.regexp_replace(F.lower("__said"), deixis, "")
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(f"({action})"), 1)))
    d = d.where(words_.matches(F.col(said), deixis)).withColumn("actions", terms).where(F.size("actions") > 0)
    return d.select(*keys, order, F.greatest(F.lit(0.0), F.col("__lo") - pad).alias("start"), (F.col("__hi") + pad).alias("end"), "actions")


def kinds_in(windows: DataFrame, anchors: DataFrame, keys: list[str], w: tuple[str, str], a: tuple[str, str], kind: str, bucket: float) -> DataFrame:
    """keys, window bounds and the sorted distinct kinds of the anchors that overlap it (half-open)."""
    return intervals.overlap_join(windows, anchors, keys, w, a, bucket, closed=False).groupBy(*keys, *w).agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
