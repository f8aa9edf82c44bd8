"""Vocabulary and merges of a byte-level BPE tokenizer: small driver-side values with DataFrame views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from inkspan.plans.config import SPECIAL_TOKENS


@dataclass
class Vocabulary:
    """Ids from 0: special tokens, 256 bytes, then merged tokens. Bytes that are there already keep their id, special ones too."""

    special_tokens: tuple[str, ...] = SPECIAL_TOKENS
    tokens: list[bytes] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    ids: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        if not self.tokens:
            for t in self.special_tokens:
                self._put(t.encode(), "special")
            for b in range(256):
                self._put(bytes([b]), "byte")

    def _put(self, token: bytes, kind: str) -> int:
        self.ids.setdefault(token, len(self.tokens))
        self.tokens.append(token)
        self.kinds.append(kind)
        return len(self.tokens) - 1

    @property
    def base_byte_start(self) -> int:
        return len(self.special_tokens)

    @property
    def bpe_start(self) -> int:
        return self.base_byte_start + 256

    def __len__(self) -> int:
        return len(self.tokens)

    def add(self, token: bytes) -> int:
        return self.ids[token] if token in self.ids else self._put(token, "bpe")

    def id_of(self, token: bytes) -> int | None:
        return self.ids.get(token)

    def token_of(self, token_id: int) -> bytes | None:
        return self.tokens[token_id] if 0 <= token_id < len(self.tokens) else None

    def kind_of(self, token_id: int) -> str | None:
        return self.kinds[token_id] if 0 <= token_id < len(self.kinds) else None

    def special_id(self, token: str) -> int:
        return {t: i for i, t in enumerate(self.special_tokens)}[token]

    def special_token(self, token_id: int) -> str:
        if not self.is_special_id(token_id):
            raise KeyError(token_id)
        return self.special_tokens[token_id]

    def is_special(self, text: str) -> bool:
        return text in self.special_tokens

    def is_special_id(self, token_id: int) -> bool:
        return 0 <= token_id < len(self.special_tokens)

    @property
    def special_count(self) -> int:
        return len(self.special_tokens)

    def special_list(self) -> list[str]:
        return list(self.special_tokens)

    @property
    def max_special_id(self) -> int:
        return len(self.special_tokens) - 1

    def to_json(self) -> dict:
        return {str(i): {"bytes": t.hex(), "type": k} for i, (t, k) in enumerate(zip(self.tokens, self.kinds, strict=True))}

    @classmethod
    def from_json(cls, found: dict, special_tokens: tuple[str, ...]) -> Vocabulary:
        """Merged tokens are added anew in the order of their ids, so gaps close."""
        out = cls(tuple(special_tokens))
        for i in sorted(found, key=int):
            if found[i]["type"] == "bpe":
                out.add(bytes.fromhex(found[i]["bytes"]))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(t), k) for i, (t, k) in enumerate(zip(self.tokens, self.kinds, strict=True))], "id int, bytes binary, type string")


@dataclass(frozen=True)
class Merge:
    rank: int
    left: int
    right: int
    new_token_id: int
    frequency: int

    def to_json(self) -> dict:
        return {"rank": self.rank, "left": self.left, "right": self.right, "new_token_id": self.new_token_id, "frequency": self.frequency}


class Merges(list):
    """Merges in the order of rank."""

    def record(self, left: int, right: int, new: int, frequency: int) -> Merge:
        self.append(Merge(len(self), left, right, new, frequency))
        return self[-1]

    def rank_of(self, left: int, right: int) -> int:
        """The rank of the last merge of this pair, -1 if there is none."""
        return next((m.rank for m in reversed(self) if (m.left, m.right) == (left, right)), -1)

    def at(self, rank: int) -> Merge:
        if not 0 <= rank < len(self):
            raise IndexError(f"no merge of rank {rank}")
        return self[rank]

    def to_json(self) -> list[dict]:
        return [m.to_json() for m in self]

    @classmethod
    def from_json(cls, found: list[dict]) -> Merges:
        return cls(Merge(m["rank"], m["left"], m["right"], m["new_token_id"], m["frequency"]) for m in found)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m.rank, m.left, m.right, m.new_token_id, m.frequency) for m in self], "rank int, left int, right int, new_token_id int, frequency long")

    def batches(self) -> list[list[Merge]]:
        """Runs of merges, in order, that can be applied in one pass: none makes, or shares an end with, another's occurrence."""
        out: list[list[Merge]] = []
        for m in self:
            run = out[-1] if out else []
            lefts, rights, made = {x.left for x in run}, {x.right for x in run}, {x.new_token_id for x in run}
            alone = m.left == m.right or any(x.left == x.right for x in run)
            if not run or alone or m.left in rights or m.right in lefts or {m.left, m.right} & made or m.new_token_id in lefts | rights:
                out.append([m])
            else:
                run.append(m)
        return out
