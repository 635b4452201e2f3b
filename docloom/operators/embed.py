"""Embedding models: registry, prefixes, and the column they add.

Model weights cannot be part of this repository. A registry entry carries what
the engine does around a model: dimension, prefixes, pooling, input limit and
the L2 step. ``backend`` is a factory called once per Python worker that
returns ``texts -> float32 (n, dim)``: ``transformer_backend`` runs a real model
where the optional libraries are installed, ``hash_backend`` is deterministic
and knows nothing of meaning.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip
from docloom.ship import ship

Backend = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class EmbeddingModel:
    name: str
    dim: int
    query_prefix: str
    document_prefix: str
    pooling: str
    max_tokens: int | None
    #: A text that starts with one of these is left as it is (after stripping).
    known_prefixes: tuple[str, ...]

    def prefixed(self, text: Column, is_query: bool) -> Column:
        bare = strip(text)
        prefix = self.query_prefix if is_query else self.document_prefix
        if not prefix:
            return bare
        known = F.lit(False)
        for p in self.known_prefixes:
            known = known | bare.startswith(p)
        return F.when(known, bare).otherwise(F.concat(F.lit(prefix), bare))

    def prefixed_sql(self, text: str, is_query: bool) -> str:
        from docloom.functions.text import strip_sql

        bare = strip_sql(text)
        prefix = self.query_prefix if is_query else self.document_prefix
        if not prefix:
            return bare
        known = " OR ".join(f"starts_with({bare}, '{p}')" for p in self.known_prefixes)
        return f"CASE WHEN {known} THEN {bare} ELSE '{prefix}' || {bare} END"


#: Model names, sizes and prefixes.
MODELS = {
    "bge": EmbeddingModel("BAAI/bge-large-en", 1024, "Represent this sentence for searching relevant passages: ", "", "cls", 512, ("Represent this sentence for searching relevant passages: ",)),
    "nomic": EmbeddingModel("nomic-ai/nomic-embed-text-v1", 768, "search_query: ", "search_document: ", "mean", 512, ("search_query: ", "search_document: ")),
    "e5": EmbeddingModel("intfloat/e5-large", 1024, "query: ", "passage: ", "delegated", None, ("query: ", "passage: ")),
}


def pool(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """(texts, tokens, dim) token vectors to one vector a text: the first token's, or the mean over the tokens of the mask."""
    if how == "cls":
        return hidden[:, 0]
    if how == "mean":
        weight = mask[:, :, None].astype(np.float32)
        return (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    raise ValueError(f"no pooling named {how}")


def pick_device(asked: str | None = None) -> str:
    """The device asked for, else a GPU where the worker has one, else the CPU."""
    if asked:
        return asked
    try:
        import torch

        return "cuda" if torch.cuda.is_available() else "cpu"
    except ImportError:
        return "cpu"


def _load_transformer(name: str, device: str):
    """(tokenizer, model) of the public libraries; the model sits on ``device``, or is spread by them if that fails to fit."""
    from transformers import AutoModel, AutoTokenizer

    tokenizer = AutoTokenizer.from_pretrained(name, trust_remote_code=True)
    model = None
    if device == "cuda":
        with contextlib.suppress(ImportError, ValueError):  # a library, or a model, without device maps
            model = AutoModel.from_pretrained(name, trust_remote_code=True, device_map="auto")
    if model is None:
        model = AutoModel.from_pretrained(name, trust_remote_code=True).to(device)
    model.eval()
    return tokenizer, model


def _load_sentence_model(name: str, device: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name, device=device)


def _as_numpy(x) -> np.ndarray:
    for step in ("detach", "cpu"):
        x = getattr(x, step)() if hasattr(x, step) else x
    return np.asarray(x)


def transformer_backend(model: EmbeddingModel, *, device: str | None = None, load: Callable | None = None) -> Callable[[], Backend]:
    """A backend that runs a real model, loaded once per Python worker on its own device.

    ``load(name, device)`` returns a tokenizer and a model, or one sentence model
    where pooling is ``delegated``; by default the public libraries are imported then.
    Texts are cut at ``max_tokens`` tokens, padded to the longest of their batch, and pooled as the registry says.
    """

    def open_() -> Backend:
        where = pick_device(device)
        if model.pooling == "delegated":
            sentence = (load or _load_sentence_model)(model.name, where)

            def delegate(texts: list[str]) -> np.ndarray:
                return np.asarray(sentence.encode(texts, batch_size=len(texts), normalize_embeddings=True, convert_to_numpy=True, show_progress_bar=False), np.float32)

            return delegate
        tokenizer, net = (load or _load_transformer)(model.name, where)

        def encode(texts: list[str]) -> np.ndarray:
            try:
                from torch import no_grad
            except ImportError:  # a model of another library
                from contextlib import nullcontext as no_grad
            cut = {"truncation": True, "max_length": model.max_tokens} if model.max_tokens else {}
            tokens = tokenizer(texts, padding=True, return_tensors="pt", **cut)
            with no_grad():
                hidden = net(**{k: v.to(where) if hasattr(v, "to") else v for k, v in tokens.items()})[0]
            return pool(_as_numpy(hidden), _as_numpy(tokens["attention_mask"]), model.pooling).astype(np.float32)

        return encode

    return open_


#: Bytes of word vectors that a task of the stand-in remembers.
_KNOWN_BYTES = 32 << 20


def hash_backend(dim: int) -> Callable[[], Backend]:
    """A stand-in without a model: sums of vectors that the md5 digits of each word spell.

    Component j of a word is the j-th hexadecimal digit, less 7.5, of md5(word); past 32
    components, of md5(word followed by a blank and the number of the 32s before).
    """

    def vector(word: str) -> np.ndarray:
        digits = "".join(hashlib.md5((f"{word} {k}" if k else word).encode()).hexdigest() for k in range(-(-dim // 32)))
        return np.frombuffer(bytes.fromhex(digits), np.uint8).repeat(2)[:dim]

    def open_() -> Backend:
        number, table = {}, np.zeros((0, dim), np.uint8)  # words of the task's texts so far, and their vectors

        def encode(texts: list[str]) -> np.ndarray:
            nonlocal number, table
            if len(number) * dim > _KNOWN_BYTES:
                number, table = {}, table[:0]
            words, fresh, known = [t.lower().split() for t in texts], [], len(number)
            which = np.fromiter((number[w] if w in number else number.setdefault(w, len(fresh.append(w) or number)) for ws in words for w in ws), np.int64)
            if fresh:
                raw = np.stack([vector(w) for w in fresh])
                raw[:, ::2] >>= 4
                raw &= 15
                if len(number) > len(table):  # room for as many again
                    table = np.concatenate((table[:known], np.zeros((len(number), dim), np.uint8)))
                table[known : len(number)] = raw
            owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
            out = np.zeros((len(texts), dim), np.float64)
            if len(owner):
                pair, times = np.unique(owner * len(number) + which, return_counts=True)
                row = pair // len(number)
                parts = (table[pair % len(number)] - 7.5) * times[:, None]
                lead = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                out[row[lead]] = np.add.reduceat(parts, lead)
            return out.astype(np.float32)

        return encode

    return open_


def embed(df: DataFrame, model: EmbeddingModel, *, text_col: str = "content", out: str = "embedding", is_query: bool = False, batch_size: int = 16, backend: Callable[[], Backend] | None = None, normalize: bool = True) -> DataFrame:
    """Adds ``out`` (array<float>): prefix, encode in batches, L2-normalise. Null texts count as empty.

    Without a ``backend`` a model of the registry runs through
    ``transformer_backend``, any other through ``hash_backend``.
    """
    ship(df.sparkSession)
    open_ = backend or (transformer_backend(model) if model in MODELS.values() else hash_backend(model.dim))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = open_()
        for texts in batches:
            rows = []
            for at in range(0, len(texts), batch_size):
                block = np.asarray(run(texts.iloc[at : at + batch_size].tolist()), np.float32)
                if normalize:
                    block = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
                rows.extend(block)
            yield pd.Series(rows, index=texts.index, dtype=object)

    return df.withColumn(out, encode(model.prefixed(F.coalesce(F.col(text_col), F.lit("")), is_query)))
