"""Replaceable outside services and their deterministic offline stand-ins.

Providers work on batches inside tasks: Spark splits the rows, a provider only sees the texts
of one Arrow batch.  Nothing here is needed by the relational operators.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULT, EngineConfig
from lectern.operators.lineage import cut_lineage


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str], kind: str) -> np.ndarray: ...


class Chat(Protocol):
    def stream(self, messages: list[dict], tools: list[dict] | None = None) -> Iterator[dict]: ...


class PageReader(Protocol):
    def pages(self, content: bytes) -> list[str]: ...

    def markdown(self, content: bytes) -> str: ...

    def has_table(self, page: str) -> bool: ...


class HashingEmbedder:
    """Signed hashing of lower-cased words, scaled to length 1."""

    def __init__(self, dim: int = DEFAULT.embedding_dim) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str], kind: str = "passage") -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1.0 if h & (1 << 40) else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


class PlainPages:
    """Treats the bytes as UTF-8 text with form feeds between pages."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")

    def markdown(self, content: bytes) -> str:
        return "\n\n".join(self.pages(content))

    def has_table(self, page: str) -> bool:
        return any(line.lstrip().startswith("|") for line in page.split("\n"))


class ExtractiveChat:
    """Answers with the first sentence of the first numbered passage of the prompt."""

    def stream(self, messages: list[dict], tools: list[dict] | None = None) -> Iterator[dict]:
        prompt = messages[-1]["content"]
        found = re.search(r"\[1\][^\n]*\n(.+?)(?:[.!?](?:\s|$)|$)", prompt, re.DOTALL)
        answer = f"{found.group(1).strip()} [1]" if found else "La informació no es troba als documents."
        for token in re.findall(r"\S+\s*", answer):
            yield {"content": token}


def embed_texts(
    primary: Embedder, texts: Sequence[str], kind: str = "passage", fallback: Embedder | None = None,
    cfg: EngineConfig = DEFAULT, sleep: Callable[[float], None] = time.sleep,
) -> tuple[list[list[float]], str | None]:
    """Vectors and an error text (None on success).

    Works in batches with retries and growing pauses.  When a batch fails for good, the
    fallback embeds all texts again; without one the vectors made so far are returned.
    """
    done: list[list[float]] = []
    for start in range(0, len(texts), cfg.embedding_batch):
        batch = list(texts[start:start + cfg.embedding_batch])
        for attempt in range(cfg.embedding_attempts):
            try:
                done.extend(np.asarray(primary.embed(batch, kind)).tolist())
                break
            except Exception as exc:  # any service error counts
                if attempt + 1 < cfg.embedding_attempts:
                    sleep(2.0**attempt)
                    continue
                if fallback is None:
                    return done, f"batch at {start} failed {cfg.embedding_attempts} times: {exc}"
                try:
                    return np.asarray(fallback.embed(list(texts), kind)).tolist(), None
                except Exception as second:
                    return [], str(second)
    return done, None


def _vectors_or_error(text: Column, model: Embedder, kind: str, cfg: EngineConfig) -> Column:
    """(vector, error) of each text; texts after a failure have the error."""

    @F.arrow_udf("struct<vector:array<float>,error:string>")
    def run(batch: pa.Array) -> pa.Array:
        vectors, error = embed_texts(model, batch.fill_null("").to_pylist(), kind, None, cfg)
        rows = np.asarray(vectors, np.float32).reshape(len(vectors), -1) if vectors else np.zeros((0, 0), np.float32)
        at = np.minimum(np.arange(len(batch) + 1), len(rows)).astype(np.int32) * np.int32(rows.shape[1] if len(rows) else 0)
        missing = np.arange(len(batch)) >= len(rows)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()), mask=pa.array(missing))
        return pa.StructArray.from_arrays([lists, pa.array(np.where(missing, error, None), pa.string())], ["vector", "error"])

    return run(text)


def embedding(text: Column | str, model: Embedder, cfg: EngineConfig = DEFAULT, kind: str = "passage") -> Column:
    """Vector column of one model; a task fails (and is retried by Spark) rather than leaving gaps."""
    found = _vectors_or_error(F.col(text) if isinstance(text, str) else text, model, kind, cfg)
    return F.when(found["error"].isNotNull(), F.raise_error(found["error"]).cast("array<float>")).otherwise(found["vector"])


def embedded(
    df: DataFrame, text: str, primary: Embedder, fallback: Embedder | None = None, cfg: EngineConfig = DEFAULT, kind: str = "passage",
    name: str = "embedding",
) -> DataFrame:
    """``df`` with the vectors of ``text``, all of one model: if the primary one fails for any row, the fallback embeds all.

    Rows are written with their vectors before anyone sees them, so a service is asked once a row.
    """
    staged = df
    for model in (primary, fallback):
        staged = cut_lineage(staged.withColumn("_made", _vectors_or_error(F.col(text), model, kind, cfg)))
        failed = staged.filter("_made.error IS NOT NULL").select("_made.error").first()
        if failed is None:
            return staged.withColumn(name, F.col("_made.vector")).drop("_made")
        if model is fallback or fallback is None:
            break
        staged = staged.drop("_made")
    raise RuntimeError(failed[0])


EXTRACT_DDL = "pages array<string>, markdown string, table_pages array<int>, extraction_method string, error string"


def extract_pages(files: DataFrame, reader: PageReader, fast: bool = False) -> DataFrame:
    """Add page texts, rich text, pages with tables, the method and an error to ``files`` (content).

    A document that cannot be read gets an error text; the rich text falls back to the pages.
    """
    keep = [c for c in files.columns if c != "content"]

    def read(content: bytes) -> tuple:
        try:
            pages = reader.pages(content)
        except Exception as exc:
            return None, None, [], None, str(exc)
        try:
            tables = [i for i, page in enumerate(pages, 1) if reader.has_table(page)]
        except Exception:
            tables = []
        if not fast:
            try:
                return pages, reader.markdown(content), tables, "rich", None
            except Exception:
                pass
        return pages, None, tables, "plain", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = pd.DataFrame(
                [read(c) for c in batch["content"]],
                columns=["pages", "markdown", "table_pages", "extraction_method", "error"], index=batch.index,
            )
            yield pd.concat([batch[keep], new], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")
    return files.mapInPandas(run, f"{kept}, {EXTRACT_DDL}")


def _reply(chat: Chat, text: str, system: str | None = None) -> str | None:
    before = [] if system is None else [{"role": "system", "content": system}]
    try:
        return "".join(part.get("content", "") for part in chat.stream([*before, {"role": "user", "content": text}]))
    except Exception:
        return None


def chat_column(prompt: Column, chat: Chat, system: str | None = None) -> Column:
    """Full reply of a chat model to each prompt, NULL where the model failed."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _reply(chat, t, system) for t in batch.to_pylist()], pa.string())

    return run(prompt)


def chat_list_column(prompts: Column, chat: Chat) -> Column:
    """The replies to a list of prompts, empty ones where the model failed; a row stays where it is."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([[_reply(chat, t) or "" for t in texts or []] for texts in batch.to_pylist()], pa.list_(pa.string()))

    return run(prompts)


def tool_result(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)
