"""Encoding and decoding columns with a trained tokenizer, and its files."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkspan.plans.config import Tokenizer as Config

from .bpe import Training, apply
from .vocabulary import Merge, Merges, Vocabulary


class Tokenizer:
    """Columns in, columns out; the vocabulary travels with the functions, its size is that of the configuration."""

    def __init__(self, config: Config | None = None, vocabulary: Vocabulary | None = None, merges: Merges | None = None):
        self.config = config or Config()
        both = vocabulary is not None and merges is not None
        self.vocabulary = vocabulary if both else Vocabulary(self.config.special_tokens)
        self.merges = merges if both else Merges()

    @classmethod
    def of(cls, training: Training, config: Config) -> Tokenizer:
        return cls(config, training.vocabulary, training.merges)

    @property
    def vocab_size(self) -> int:
        return len(self.vocabulary)

    # --- columns

    def encode(self, text: Column) -> Column:
        """ARRAY<INT>. A text that is a special token is its id; otherwise merges are applied in the order of rank, each in a
        full pass (passes that can't meet are one), so a rank is never gone back to."""
        batches, base = self.merges.batches(), self.vocabulary.base_byte_start
        special = {t: i for i, t in enumerate(self.vocabulary.special_tokens)}

        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            out: list = [None] * len(texts)
            known = [(i, t) for i, t in enumerate(texts) if t is not None]
            for i, t in known:
                if t in special:
                    out[i] = [special[t]]
            rows = [(i, t) for i, t in known if t not in special]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                pieces = [np.append(np.frombuffer(t.encode(), np.uint8).astype(np.int32) + base, np.int32(-1)) for _, t in part]
                x, starts = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                for batch in batches:
                    x, starts = apply(x, starts, batch)
                for (i, _), a, b in zip(part, starts[:-1], starts[1:], strict=True):
                    out[i] = x[a : b - 1]
            return pd.Series(out, dtype=object)

        return run(text)

    def encode_native(self, text: Column) -> Column:
        """The same without Python, for short merge lists without reused ids: a token is a character, a merge a replacement."""
        if len({m.new_token_id for m in self.merges}) < len(self.merges) or any(m.new_token_id < self.vocabulary.bpe_start for m in self.merges):
            raise ValueError("a merge reuses an id")
        k = self.vocabulary.base_byte_start
        if self.vocab_size - k > 0xD800:
            raise ValueError("more tokens than there are code points below the surrogates")
        char = lambda i: chr(i - k)
        s = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
        for m in self.merges:
            s = F.replace(s, F.lit(char(m.left) + char(m.right)), F.lit(char(m.new_token_id)))
        ids = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) + k)
        for i, t in enumerate(self.vocabulary.special_tokens):
            ids = F.when(text == t, F.array(F.lit(i))).otherwise(ids)
        return ids

    def encode_with_special_tokens(self, text: Column) -> Column:
        v = self.vocabulary
        return F.concat(F.array(F.lit(v.special_id("<DOCUMENT_START>"))), self.encode(text), F.array(F.lit(v.special_id("<DOCUMENT_END>"))))

    def tokenize(self, text: Column) -> Column:
        """ARRAY<STRUCT<id, bytes>>, bytes in lower-case hexadecimal."""
        table = F.array(*[F.lit(t.hex()) for t in self.vocabulary.tokens])
        return F.transform(self.encode(text), lambda i: F.struct(i.alias("id"), F.element_at(table, i + 1).alias("bytes")))

    def decode(self, ids: Column, special: bool = False) -> Column:
        """Text of ids. Unknown ids are dropped, special ones too unless ``special``. Bytes that are no UTF-8 raise; with
        ``special`` each token is decoded alone, so a part of a character raises."""
        tokens, n = self.vocabulary.tokens, len(self.vocabulary.special_tokens)
        held, size = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        begin = np.cumsum(size) - size

        @F.pandas_udf("string")
        def run(rows: pd.Series) -> pd.Series:
            there = rows.notna().to_numpy()
            lists = [np.asarray(r, np.int64) for r in rows[there]]
            flat = np.concatenate([np.zeros(0, np.int64), *lists])
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            keep = (flat >= (0 if special else n)) & (flat < len(tokens))
            flat, row = flat[keep], row[keep]
            if special:
                for i in np.unique(flat):
                    tokens[i].decode()  # raises if it is no whole text
            # the bytes of all tokens on end, gathered from the table at once
            lengths = size[flat]
            place = np.repeat(begin[flat] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            joined = held[place].tobytes()
            ends = np.cumsum(np.bincount(row, weights=lengths, minlength=len(lists))).astype(np.int64).tolist()
            out = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            out[there] = [joined[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
            return out

        return run(ids)

    def decode_with_special_tokens(self, ids: Column) -> Column:
        return self.decode(ids, special=True)

    # --- bytes alone

    def byte_encode(self, text: Column) -> Column:
        """Base ids of the UTF-8 bytes, without merges; native."""
        k = self.vocabulary.base_byte_start
        return F.transform(F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != ""), lambda c: F.ascii(c) + k)

    def byte_encode_document(self, text: Column) -> Column:
        v = self.vocabulary
        return F.concat(F.array(F.lit(v.special_id("<DOCUMENT_START>"))), self.byte_encode(text), F.array(F.lit(v.special_id("<DOCUMENT_END>"))))

    def byte_decode(self, ids: Column) -> Column:
        """Text of base ids; special ids are dropped, ids beyond the bytes and bytes that are no UTF-8 raise; native."""
        k = self.vocabulary.base_byte_start
        one = lambda i: F.when(i >= k + 256, F.raise_error(F.concat(F.lit("no byte: id "), i.cast("string")))).otherwise(F.char(i - k))
        chars = F.transform(F.filter(ids, lambda i: i >= k), one)
        return F.decode(F.encode(F.array_join(chars, ""), "ISO-8859-1"), "UTF-8")

    # --- lookups

    def token_to_id(self, token: bytes) -> int | None:
        return self.vocabulary.id_of(token)

    def id_to_token(self, token_id: int) -> bytes | None:
        return self.vocabulary.token_of(token_id)

    def get_merge(self, rank: int) -> Merge:
        return self.merges.at(rank)

    def inspect_merges(self, spark: SparkSession, n: int = 10) -> DataFrame:
        """(rank, left_bytes, right_bytes, new_bytes, frequency) of the first n merges."""
        hexed = lambda name: self.vocabulary.frame(spark).select(F.col("id").alias(name), F.lower(F.hex("bytes")).alias(f"{name}_bytes"))
        m = self.merges.frame(spark).where(F.col("rank") < n).withColumnRenamed("new_token_id", "new")
        for side in ("left", "right", "new"):
            m = m.join(F.broadcast(hexed(side)), side)
        return m.select("rank", "left_bytes", "right_bytes", "new_bytes", "frequency")

    # --- files

    def save(self, folder: str | Path) -> None:
        """vocab.json, merges.json, config.json and tokenizer.json."""
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        c = asdict(self.config) | {"special_tokens": list(self.config.special_tokens), "algorithm": "byte_level_bpe"}
        files = {
            "vocab.json": self.vocabulary.to_json(),
            "merges.json": self.merges.to_json(),
            "config.json": c,
            "tokenizer.json": {"config": c, "vocab_size": self.vocab_size, "merge_count": len(self.merges), "special_tokens": c["special_tokens"]},
        }
        for name, found in files.items():
            (folder / name).write_text(json.dumps(found, indent=2), encoding="utf-8")

    @classmethod
    def load(cls, folder: str | Path) -> Tokenizer:
        folder = Path(folder)
        read = lambda name: json.loads((folder / name).read_text(encoding="utf-8"))
        c = read("config.json")
        config = Config(c["vocab_size"], c["min_frequency"], tuple(c["special_tokens"]), c.get("encoding", "utf-8"), c.get("trainer", "reference"))
        return cls(config, Vocabulary.from_json(read("vocab.json"), config.special_tokens), Merges.from_json(read("merges.json")))

    def save_training(self, folder: str | Path, corpus: str | Path, statistics: dict) -> None:
        """training_statistics.json, and training_metadata.json with the corpus file's hash."""
        folder, digest = Path(folder), hashlib.sha256()
        with open(corpus, "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
        meta = {"corpus_path": str(corpus), "corpus_hash": digest.hexdigest(), "initial_token_count": statistics["initial_token_count"], "final_token_count": statistics["final_token_count"], "compression_ratio": statistics["compression_ratio"], "created_at": datetime.now(UTC).isoformat()}
        (folder / "training_metadata.json").write_text(json.dumps(meta, indent=2), encoding="utf-8")
        (folder / "training_statistics.json").write_text(json.dumps(statistics, indent=2), encoding="utf-8")
