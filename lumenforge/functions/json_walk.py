"""Walks of JSON to any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose strings are ids, and keys whose strings name an item with the id inside. Fixed values.
UID_KEYS = frozenset(["uid", "video_id", "source_uid"])
ITEM_KEYS = frozenset(["item_id", "candidate_id"])
ITEM = re.compile(r"^(?:instructional|witnessed|commentary):([^:]+):")


def in_chain(document: Column, link: str, flags: list[str]) -> Column:
    """Whether an object, or one that `link` leads to from it, however many steps away, has one of the flags true.

    The document is parsed once; its text says how many steps there can be. Null, invalid and other JSON has no flag.
    """
    v = F.try_parse_json(document)
    steps = F.regexp_count(document, F.lit(f'"{re.escape(link)}"'))

    def step(s: Column, _: Column) -> Column:
        here = F.lit(False)
        for flag in flags:
            here = here | (F.try_variant_get(s["v"], f"$.{flag}", "string") == "true") & F.coalesce(F.schema_of_variant(F.try_variant_get(s["v"], f"$.{flag}", "variant")) == "BOOLEAN", F.lit(False))
        return F.struct(F.try_variant_get(s["v"], f"$.{link}", "variant").alias("v"), (s["found"] | F.coalesce(here, F.lit(False))).alias("found"))

    found = F.aggregate(F.sequence(F.lit(0), steps), F.struct(v.alias("v"), F.lit(False).alias("found")), step)["found"]
    return F.coalesce(found, F.lit(False))


def ids_in(value) -> Iterator[str]:
    """Ids of a parsed document, at any depth; a stack instead of recursion."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if isinstance(v, str):
                    if k in UID_KEYS and v.strip():
                        yield v.strip()
                    elif k in ITEM_KEYS and (m := ITEM.match(v.strip())):
                        yield m[1]
                elif isinstance(v, dict | list):
                    stack.append(v)
        elif isinstance(x, list):
            stack += [v for v in x if isinstance(v, dict | list)]


def harvested(df: DataFrame, document: str) -> DataFrame:
    """uid: the distinct ids that documents hold at any depth. Documents that aren't JSON give none. Repeats go in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for x in b.column(0).to_pylist():
                try:
                    found.update(ids_in(json.loads(x or "null")))
                except (ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["uid"])

    return df.select(F.col(document).cast("string")).mapInArrow(run, "uid string").distinct()
