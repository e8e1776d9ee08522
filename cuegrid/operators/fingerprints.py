"""Fingerprints of stages and of the rows they consume."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_json(value: object) -> str:
    """JSON with sorted keys and without absent values; equal values have equal texts."""
    tidy = lambda v: {k: tidy(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [tidy(x) for x in v] if isinstance(v, list) else v
    return json.dumps(tidy(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def hashed(value: object) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def stage_chain(config: dict[str, object], source: str, tool: str = "1") -> dict[str, str]:
    """A fingerprint for each stage in turn, of its part of the configuration and of the one before, so a change reaches all later stages."""
    out: dict[str, str] = {}
    last = None
    for stage, part in config.items():
        last = out[stage] = hashed({"stage": stage, "tool": tool, "input": source, "config": part, "previous": last})
    return out


def chained(first: Column, parts: Column) -> Column:
    """The same chain over a column's array of texts, each step the hash of the last and the next."""
    return F.aggregate(parts, first, lambda last, x: F.sha2(F.concat(last, F.lit("|"), x), 256))


def rows_hash(rows: DataFrame, by: list[str], order: list[str], columns: list[str], block: int = 1000) -> DataFrame:
    """(by, hash) of ordered rows: of blocks of so many order values first, then of the blocks, so that no group is gathered whole."""
    item = F.struct(*order, F.to_json(F.struct(*columns)).alias("_j"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(c), lambda x: x["_j"]), "\n"), 256)
    blocks = rows.groupBy(*by, F.floor(F.col(order[0]) / block).alias("_b")).agg(joined(F.collect_list(item)).alias("_j"))
    return blocks.groupBy(*by).agg(joined(F.collect_list(F.struct("_b", "_j"))).alias("hash"))


def diarization(source: Column, model: str, speakers: int) -> Column:
    return F.concat_ws("|", source, F.lit(model), F.lit(str(speakers)))


def input_hash(source: Column, size: Column, modified_ms: Column, content_hash: Column, *, whole: int = 64 << 20) -> Column:
    """Identity of an input: of an address its text, of a file its content's hash, of one beyond ``whole`` bytes its path, size and time, of one without a size that it is missing."""
    told = F.concat_ws(":", F.lit("file"), source, size.cast("string"), modified_ms.cast("string"))
    other = F.when(size.isNull(), F.sha2(F.concat(F.lit("missing:"), source), 256)).when(size <= whole, content_hash).otherwise(F.sha2(told, 256))
    return F.when(source.rlike("(?i)^https?://"), F.sha2(F.concat(F.lit("url:"), source), 256)).otherwise(other)


def config_slices(config: dict) -> dict[str, object]:
    """The part of a configuration that each stage's output depends on; stage_chain of it tells what to do again."""
    of = lambda part, *names: {n: config.get(part, {}).get(n) for n in names}
    tts = config.get("tts", {})
    clone = tts.get("clone") or {}
    return {
        "s1": {"input": config.get("input")},
        "s2": config.get("asr"),
        "s3": {"translate": config.get("translate"), **of("alignment", "borrow_silence_ms", "gap_ms")},
        "s4": config.get("separation"),
        "s5": {k: v for k, v in tts.items() if k != "clone"},
        "s6": {"alignment": config.get("alignment"), **of("translate", "chars_per_second"), "clone": {**clone, **{"server": config.get("server", {}).get("host")}} if clone.get("enabled") else None},
        "s7": {"mix": config.get("mix"), "keep_original_track": config.get("keep_original_track")},
    }
