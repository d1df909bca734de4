"""Model calls: request digests, a response table, providers, and replies to predictions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.sources.files import KEY, items_of

#: A provider takes (model, prompt, image or None) and gives a reply; it is made once a partition.
Provider = Callable[[str, str, bytes | None], str]


def request_digest(model: Column, prompt: Column, image: Column, temperature: Column, sample: Column, extra: Column | None = None) -> Column:
    """One key of all that could change a reply: SHA-256 of a JSON text with sorted names."""
    extra = F.create_map().cast("map<string,string>") if extra is None else extra
    whole = F.struct(extra.alias("extra"), image.alias("image"), model.alias("model"), prompt.alias("prompt"), sample.alias("sample"), F.bround(temperature, 6).alias("temperature"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def prompt_hash(variant: str, system: str, rendered: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(variant), F.lit(system), rendered), 256)


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (with ``digest``) that the table of responses answers, with their reply, and those it does not."""
    known = cache.where(F.col("response").isNotNull()).groupBy("digest").agg(F.min("response").alias("response"))
    return requests.join(known, "digest"), requests.join(known, "digest", "left_anti")


def call_stats(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits and misses, one row."""
    known = cache.where(F.col("response").isNotNull()).select("digest").distinct().withColumn("hit", F.lit(1))
    return requests.join(known, "digest", "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def call(requests: DataFrame, make_provider: Callable[[], Provider]) -> DataFrame:
    """Replies of a provider: the requests' columns with ``response`` and ``error``; a failing call does not fail the run.

    Requests have model, prompt and image (binary or null).
    """
    names = [c for c in requests.columns if c not in ("response", "error")]
    schema = T.StructType([*(requests.schema[c] for c in names), T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_provider()
        for batch in batches:
            replies = []
            for model, prompt, image in batch[["model", "prompt", "image"]].itertuples(index=False):
                try:
                    replies.append((ask(model, prompt, image), None))
                except Exception as e:  # every provider raises its own kinds
                    replies.append((None, f"{type(e).__name__}: {e}"))
            yield batch[names].assign(response=[r for r, _ in replies], error=[e for _, e in replies])

    return requests.select(*names).mapInPandas(run, schema)


def scripted(answers: dict[str, str], otherwise: str | None = None) -> Callable[[], Provider]:
    """Canned replies by the first key that the prompt contains."""

    def make() -> Provider:
        def ask(model: str, prompt: str, image: bytes | None) -> str:
            found = next((a for k, a in answers.items() if k in prompt), otherwise)
            if found is None:
                raise LookupError("no scripted answer")
            return found

        return ask

    return make


def _read(text: str, whole: bool):
    """The JSON value of a text, or of what starts at its first brace (bracket, if it has no brace); None if there is none."""
    start = 0 if whole else max(0, text.find("{") if "{" in text else text.find("["))
    try:
        found, end = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return None
    return found if end == len(text) or not whole else None


def recover(text: str | None) -> str | None:
    """The JSON object of a reply as text: a fenced block's, else the whole, else the first that starts in it. A bare list is one of callouts."""
    text = text or ""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in ([fenced[1]] if fenced else []) + [text]:
        part = part.strip()
        found = _read(part, True)
        found = _read(part, False) if found is None else found
        if isinstance(found, list):
            found = {"characteristics": found}
        if isinstance(found, dict):
            return json.dumps(found)
    return None


recovered = F.udf(recover, T.StringType(), useArrow=True)


def reply_items(replies: DataFrame) -> DataFrame:
    """Judged items of (drawing_id, units, response). Missing ids and views are filled in, nothing else; no JSON is one malformed item."""
    found = replies.withColumn("payload", recovered("response")).withColumn("p", F.from_json("payload", "units STRING, characteristics ARRAY<STRING>, results ARRAY<STRING>"))
    items = F.coalesce("p.characteristics", "p.results", F.array().cast("array<string>"))
    filled = F.transform(items, lambda raw, i: _filled(raw, i))
    return items_of(found.select(KEY, F.coalesce("p.units", "units").alias("units"), F.when(F.col("payload").isNull(), F.array(F.lit(None).cast("string"))).otherwise(filled).alias("items")))


def _filled(raw: Column, i: Column) -> Column:
    id_, view = F.get_json_object(raw, "$.id"), F.get_json_object(raw, "$.view")
    more = F.concat_ws(",", F.when(F.coalesce(id_, F.lit("0")).isin("0", ""), F.concat(F.lit('"id":'), (i + 1).cast("string"))), F.when(F.coalesce(view, F.lit("")) == "", F.lit('"view":"unknown"')))
    empty = F.json_object_keys(raw).isNull() | (F.size(F.json_object_keys(raw)) == 0)
    return F.when((more == "") | empty, raw).otherwise(F.concat(F.regexp_replace(raw, r"\}\s*$", ","), more, F.lit("}")))


def save_responses(replies: DataFrame, path: str) -> None:
    """New replies appended to the table of responses; whole files appear at once, so readers never see half an entry."""
    replies.where(F.col("response").isNotNull()).select("digest", "model", "response").write.mode("append").parquet(path)
