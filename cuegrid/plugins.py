"""Interfaces of models that stay outside the engine, with stand-ins that always answer alike."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Chat(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Recogniser(Protocol):
    def words(self, samples: list[float], rate: int) -> list[tuple[str, float, float]]: ...


class Echo:
    """Answers with the text in capitals; an empty text gets no answer."""

    def complete(self, system: str, user: str) -> str:
        return user.upper()


REGISTRY: dict[str, Callable[[], Chat]] = {"echo": Echo}


def factory(name: str) -> Callable[[], Chat]:
    """What makes the client of a name, or of the part before a slash."""
    return REGISTRY[name if name in REGISTRY else name.split("/")[0]]


def chat(name: str) -> Chat:
    return factory(name)()


def translated(rows: DataFrame, model: str = "echo", *, attempts: int = 3, context: int = 3) -> DataFrame:
    """rows (recording_id, id, batch, text) with ``text_tgt``: batches of a recording in turn, each told the last translations of the one before. A row that gets no answer in so many attempts stays null, as one without text does.

    Recordings stand sorted in their partitions and come in bounded Arrow batches; the last translations go on from one to the next.
    """

    made = factory(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, told, now = made(), "", object()
        for batch in batches:
            answers = []
            for recording, text in zip(batch.column("recording_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if recording != now:
                    told, now = "", recording
                answer = None if text is None else next((a for _ in range(attempts) if (a := client.complete(told, text))), None)
                told = "\n".join([*told.split("\n"), answer or ""][-context:])
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("recording_id", "id", "batch", "text")), pa.array(answers, pa.string())], ["recording_id", "id", "batch", "text", "text_tgt"])

    kinds = rows.select(F.col("recording_id").cast("long"), F.col("id").cast("long"), F.col("batch").cast("long"), "text")
    return kinds.repartition("recording_id").sortWithinPartitions("recording_id", "batch", "id").mapInArrow(run, "recording_id long, id long, batch long, text string, text_tgt string")


def compared(rows: DataFrame, models: list[str]) -> Iterator[tuple[str, DataFrame]]:
    """Each model's translation of the same rows; one model's failure does not stop the others, as each is a job of its own."""
    for name in models:
        yield name, translated(rows, name)


class Glossary:
    """A stand-in that answers a batch request line by line: the sizes of the glossary and of the context that it was told, then the text. It never answers lines of fewer than eight characters, and adds the first line's first word to the glossary."""

    def complete(self, system: str, user: str) -> str:
        told, lines = json.loads(system), [json.loads(x) for x in user.split("\n")]
        items = [{"id": x["id"], "text": f"{len(told['glossary'])}/{len(told['context'])} {x['text']}"} for x in lines if len(x["text"]) >= 8]
        first = lines[0]["text"].split(" ")[0]
        return json.dumps({"items": items, "glossary": {first: str(len(first))} if first else {}})


REGISTRY["glossary"] = Glossary
BATCHES = "recording_id long, id long, batch long, text string, text_tgt string, attempts int"


def _answers(reply: str, wanted: set[int]) -> tuple[dict[int, str], dict[str, str]]:
    """(texts by id, new glossary) of a reply; what is no JSON, or of another shape, answers nothing."""
    try:
        told = json.loads(reply)
        texts = {x["id"]: x["text"].strip() for x in told["items"] if x.get("id") in wanted and isinstance(x.get("text"), str)}
        return {k: t for k, t in texts.items() if t}, {str(k): str(v) for k, v in (told.get("glossary") or {}).items()}
    except (ValueError, KeyError, TypeError, AttributeError):
        return {}, {}


def _translated_batch(client: Chat, rows: list[tuple], glossary: dict[str, str], context: list[str], attempts: int) -> tuple[dict[int, str], int]:
    """The texts by id of one batch, and the attempts it took. An attempt that leaves a line out is made again; the last one counts as far as it goes, with what earlier ones answered."""
    lines = [(i, t) for i, t in rows if t and t.strip()]
    if not lines:
        return {}, 0
    user = "\n".join(json.dumps({"id": i, "text": t}, ensure_ascii=False) for i, t in lines)
    done: dict[int, str] = {}
    for k in range(1, attempts + 1):
        texts, terms = _answers(client.complete(json.dumps({"glossary": glossary, "context": context}, ensure_ascii=False), user), {i for i, _ in lines})
        if len(texts) == len(lines) or k == attempts:
            glossary |= {a: b for a, b in terms.items() if a not in glossary}
            return done | texts, k
        done |= texts
    return done, attempts


def translated_batches(rows: DataFrame, model: str, *, attempts: int = 3, context: int = 3) -> DataFrame:
    """rows (recording_id, id, batch, text) with ``text_tgt`` and ``attempts``: one request for each batch, in turn, told the recording's glossary so far and the last rows before the batch with their translations.

    Terms that a reply names are kept for all later batches of the recording; the first translation of a term stays. A
    batch is asked again while a line is missing, at most so often; then what there is counts and the rest stays null.
    A row without a text is not sent. A recording's batches depend on each other, so they stand sorted in one partition
    and go through in bounded Arrow batches; what is held is one batch, the glossary and the context.
    """
    made = factory(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, now, glossary, told, held = made(), None, {}, [], []

        def flush() -> list[tuple]:
            nonlocal told
            texts, k = _translated_batch(client, [(i, t) for _, i, _, t in held], glossary, told, attempts)
            out = [(*row, texts.get(row[1]), k) for row in held]
            told = [*told, *(f"{r[3]} > {r[4]}" for r in out)][-context:]
            held.clear()
            return out

        def sent(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()))], ["recording_id", "id", "batch", "text", "text_tgt", "attempts"])

        for arrow in batches:
            done = []
            for row in zip(*(arrow.column(c).to_pylist() for c in ("recording_id", "id", "batch", "text")), strict=True):
                if held and (held[-1][0], held[-1][2]) != (row[0], row[2]):
                    done += flush()
                if row[0] != now:
                    now, glossary, told = row[0], {}, []
                held.append(row)
            yield sent(done)
        if held:
            yield sent(flush())

    kinds = rows.select(F.col("recording_id").cast("long"), F.col("id").cast("long"), F.col("batch").cast("long"), "text")
    return kinds.repartition("recording_id").sortWithinPartitions("recording_id", "batch", "id").mapInArrow(run, BATCHES)
