"""Training and coding against a small one-by-one model."""

import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkspan.operators import bpe, checks, durable
from inkspan.operators.codec import Tokenizer
from inkspan.operators.vocabulary import Merges, Vocabulary
from inkspan.plans.config import Tokenizer as Config


def _merge(seq, left, right, new):
    out, i = [], 0
    while i < len(seq):
        if seq[i : i + 2] == [left, right]:
            out.append(new)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


def model(texts, config):
    """One merge at a time, recounting everything."""
    v, merges = Vocabulary(config.special_tokens), Merges()
    k = len(config.special_tokens)
    seqs = [[k + b for b in t.encode()] for t in texts]
    for _ in range(config.vocab_size - len(v)):
        counts = Counter(p for s in seqs for p in zip(s, s[1:], strict=False) if min(p) >= k)
        if not counts:
            break
        (left, right), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n < config.min_frequency:
            break
        merges.record(left, right, v.add(v.tokens[left] + v.tokens[right]), n)
        seqs = [_merge(s, left, right, merges[-1].new_token_id) for s in seqs]
    return v, merges, seqs


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")


CORPORA = [
    ["hello hello hello", "world world world", "héllo wörld €100", ""],
    ["aaaaaaaaaa", "aaabaaabaaab", "aaaa bbbb aabb"],
    ["".join(random.Random(s).choice("ab") for _ in range(120)) for s in range(6)],
    ["".join(random.Random(s).choice("abcd ") for _ in range(200)) for s in range(8)],
]


@pytest.mark.parametrize("texts", CORPORA)
def test_training_equals_one_by_one(spark, texts):
    config = Config(vocab_size=259 + 24)
    v, merges, seqs = model(texts, config)
    got = bpe.train(_frame(spark, texts), config)
    assert list(got.merges) == list(merges)
    assert got.vocabulary.tokens == v.tokens
    assert got.statistics["final_token_count"] == sum(len(s) + 2 for s in seqs)
    assert got.statistics["initial_token_count"] == sum(len(t.encode()) + 2 for t in texts)


def test_batches_equal_single_rounds():
    """The batch rule alone, on many small corpora heavy in runs and reuse."""
    for seed in range(150):
        rng = random.Random(seed)
        texts = ["".join(rng.choice("aab"[: rng.randint(2, 3)]) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        config = Config(vocab_size=259 + 10)
        v0, m0, _ = model(texts, config)
        v, merges = Vocabulary(), Merges()
        seqs = [[3 + b for b in t.encode()] for t in texts]
        while len(merges) < 10:
            counts = Counter(p for s in seqs for p in zip(s, s[1:], strict=False))
            ranked = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda x: (-x[2], x[0], x[1]))
            batch = bpe.next_batch(ranked, v, merges, 10 - len(merges), 2)
            if not batch:
                break
            for m in batch:
                seqs = [_merge(s, m.left, m.right, m.new_token_id) for s in seqs]
        assert list(merges) == list(m0) and v.tokens == v0.tokens


def test_special_id_reuse(spark):
    """A merge that spells a special token takes its id, and pairs with it are not counted."""
    texts = ["<x>" * 40, "<x> <x>"]
    config = Config(vocab_size=260 + 6, special_tokens=("<x>",))
    v, merges, _ = model(texts, config)
    assert 0 in [m.new_token_id for m in merges]
    assert list(bpe.train(_frame(spark, texts), config).merges) == list(merges)


def _words(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(12)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["aaaa" * 9, None, ""]


@pytest.mark.parametrize(("span", "held", "more"), [(1.2, 1 << 22, 0), (64.0, 1 << 22, 0), (2.0, 0, 0), (2.0, 1 << 22, 1 << 16)])
def test_levels_equal_one_by_one(spark, monkeypatch, span, held, more):
    """Narrow and wide levels, batches where the driver holds no segments, and ids of four bytes. No table is cached or left behind."""
    monkeypatch.setattr(bpe, "SPAN", span)
    monkeypatch.setattr(bpe, "HELD", held)
    cached, write, before = [], bpe.durable, durable.written()
    monkeypatch.setattr(bpe, "durable", lambda df, **o: (cached.append(spark.sparkContext._jsc.getPersistentRDDs().size()), write(df, **o))[1])
    spark.catalog.clearCache()
    least, texts = (12 if more else 2), _words(int(span))
    config = Config(vocab_size=259 + (more or 30), min_frequency=least)
    v, merges, seqs = model(["" if t is None else t for t in texts], config)
    got = bpe.train(_frame(spark, texts), config)
    assert list(got.merges) == list(merges) and got.vocabulary.tokens == v.tokens and len(merges) > 20
    assert got.statistics["final_token_count"] == sum(len(s) + 2 for s in seqs)
    assert not any(cached) and durable.written() == before


def test_few_passes(spark, monkeypatch):
    """A level takes the merges down to half of the largest count or less, not a batch alone."""
    passes, run = [], bpe.level_pass
    monkeypatch.setattr(bpe, "level_pass", lambda *a: (passes.append(1), run(*a))[1])
    got = bpe.train(_frame(spark, _words(5)), Config(vocab_size=259 + 60))
    assert len(got.merges) == 60 and len(passes) <= 12


def test_tokens_are_read_and_merged_by_pieces(monkeypatch):
    """Pieces of whole documents, in order, give the tokens of one pass, whatever is read at once; runs and reused ids included."""
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "ROW", 7)
    for seed in range(20):
        rng = random.Random(seed)
        texts = ["".join(rng.choice("aab") for _ in range(rng.choice([0, 3, 40, 90]))) for _ in range(9)]
        coding, (v, merges, _) = bpe.Coding(275, 3), model(texts, Config(vocab_size=259 + 5, min_frequency=1))
        batch = pa.record_batch([pa.array(["skipped", *texts])], names=["t"]).slice(1)
        whole, starts = coding.spread(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]), "<i4", -4)
        want = whole + 3
        pairs = np.sort(np.unique([m.left * 276 + m.right for m in merges if m.left < 259 and m.right < 259]))
        first = [m for m in merges if m.left < 259 and m.right < 259][:1]
        rows = [coding.rows(x) for x, _ in coding.read([batch], True)]
        back = [x for x, _ in coding.read([pa.record_batch([r], names=["t"]) for r in rows], False)]
        assert np.concatenate(back).tolist() == [275 if t < 0 else t for t in want.tolist()]
        got = np.concatenate([coding.merged(x, pairs, [first]) for x in back]).tolist()
        merged, _ = bpe.apply(want, starts, first)
        assert got == [275 if t < 0 else t for t in merged.tolist()]


def test_long_segments_are_not_gathered(spark):
    """Texts of two letters are one segment each: few rows, many bytes, which a task hands on long before its input ends."""

    class Source:
        def mapInArrow(self, run, schema):
            taken, rng = [], np.random.default_rng(7)

            def batches():
                for _ in range(100):
                    taken.append(1)
                    yield pa.record_batch([pa.array([rng.integers(97, 99, 1 << 20).astype(np.uint8).tobytes().decode()])], names=["t"])

            out = run(batches())
            sizes = [next(out).nbytes, len(taken)]
            rest = [b.nbytes for b in out]
            assert sizes[1] < 50 and max(sizes[0], *rest) < 1 << 24 and sum(rest) + sizes[0] > 200 << 20 and len(taken) == 100
            return grouped

    grouped = type("Grouped", (), {"groupBy": lambda self, *c: self, "agg": lambda self, *c: self})()

    coding = bpe.Coding(271, 3)
    pairs = np.sort([left * 272 + right for left in (100, 101) for right in (100, 101)])
    assert bpe.distinct_segments(Source(), True, coding, pairs) is grouped


def test_tables_have_small_row_groups(spark, monkeypatch):
    """A task that writes tokens holds 16 MB or so of them, not the writer's usual 128 MB."""
    groups, write = [], bpe.durable

    def kept(df, **o):
        out = write(df, **o)
        groups.extend(pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in out.inputFiles())
        return out

    monkeypatch.setattr(bpe, "durable", kept)
    texts = spark.range(0, 24000, 1, 1).select(F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(f" {i}")), 256) for i in range(32)]).alias("text"))
    assert bpe.train(texts, Config(vocab_size=259 + 200), rounds=1).statistics["num_documents"] == 24000
    assert max(groups) > 1


def test_counts_and_best(spark):
    tokens = bpe.byte_tokens(_frame(spark, ["aaa", "ab", ""]), 3)
    a, b = 3 + 97, 3 + 98
    assert {tuple(r) for r in bpe.pair_counts(tokens, 3).collect()} == {(a, a, 2), (a, b, 1)}
    assert bpe.best_pair(bpe.pair_counts(tokens, 3)) == (a, a, 2)
    ties = spark.createDataFrame([(1, 2, 5), (2, 3, 3), (3, 4, 5)], "left int, right int, freq long")
    assert bpe.best_pair(ties) == (1, 2, 5)
    with pytest.raises(ValueError):
        bpe.best_pair(ties.limit(0))


def test_no_documents(spark):
    got = bpe.train(_frame(spark, ["x"]).limit(0), Config(vocab_size=300))
    assert len(got.merges) == 0 and got.statistics["compression_ratio"] == 0.0


def _trained(texts, config):
    v, merges, _ = model(texts, config)
    return Tokenizer(config, v, merges)


def _encode(t, text):
    if t.vocabulary.is_special(text):
        return [t.vocabulary.special_id(text)]
    seq = [t.vocabulary.base_byte_start + b for b in text.encode()]
    for m in t.merges:
        seq = _merge(seq, m.left, m.right, m.new_token_id)
    return seq


@pytest.mark.parametrize("texts", CORPORA)
def test_coding(spark, texts):
    t = _trained(texts, Config(vocab_size=259 + 30))
    more = [*texts, "Revenue increased by 10%.", "café naïve €100", "<UNK>", "x<UNK>y", "aaaaaaa", None]
    df = _frame(spark, more)
    c = F.col("text")
    got = df.select("i", t.encode(c).alias("e"), t.encode_with_special_tokens(c).alias("s"), t.decode(t.encode(c)).alias("d")).orderBy("i").collect()
    for text, r in zip(more, got, strict=True):
        if text is None:
            assert r["e"] is None and r["d"] is None
            continue
        assert list(r["e"]) == _encode(t, text)
        assert list(r["s"]) == [0, *_encode(t, text), 1]
        assert r["d"] == ("" if text == "<UNK>" else text)
    if len({m.new_token_id for m in t.merges}) == len(t.merges):
        native = df.select("i", t.encode_native(c).alias("e")).orderBy("i").collect()
        assert [r["e"] for r in native] == [r["e"] for r in got]
    else:
        with pytest.raises(ValueError):
            t.encode_native(c)
    row = df.where("i = 0").select(t.tokenize(c).alias("t")).first()["t"]
    assert b"".join(bytes.fromhex(x["bytes"]) for x in row).decode() == texts[0]


def test_decoding_edges(spark):
    t = Tokenizer()
    df = spark.createDataFrame([([0, 3 + 97, 99999, 1],)], "ids array<int>")
    assert df.select(t.decode(F.col("ids"))).first()[0] == "a"
    assert df.select(t.decode_with_special_tokens(F.col("ids"))).first()[0] == "<DOCUMENT_START>a<DOCUMENT_END>"
    with pytest.raises(Exception, match="(?i)utf-8|decode"):
        spark.createDataFrame([([3 + 0xC3],)], "ids array<int>").select(t.decode(F.col("ids"))).collect()


def test_bytes_alone(spark):
    t = Tokenizer()
    texts = ["", "a\x00b", "€é", None]
    df = _frame(spark, texts)
    got = df.select("i", t.byte_encode(F.col("text")).alias("e"), t.byte_encode_document(F.col("text")).alias("d"), t.byte_decode(t.byte_encode_document(F.col("text"))).alias("b")).orderBy("i").collect()
    for x, r in zip(texts, got, strict=True):
        if x is None:
            assert r["e"] is None and r["b"] is None
        else:
            assert list(r["e"]) == [3 + b for b in x.encode()] and list(r["d"]) == [0, *r["e"], 1] and r["b"] == x
    for bad in ([3 + 256], [3 + 0xC3]):
        with pytest.raises(Exception, match="(?i)no byte|malformed"):
            spark.createDataFrame([(bad,)], "ids array<int>").select(t.byte_decode(F.col("ids"))).collect()


def test_vocabulary_and_merges():
    v = Vocabulary()
    assert (len(v), v.base_byte_start, v.bpe_start, v.max_special_id) == (259, 3, 259, 2)
    assert v.add(b"ab") == 259 and v.add(b"ab") == 259 and v.add(b"<UNK>") == 2
    assert v.kind_of(0) == "special" and v.kind_of(5) == "byte" and v.kind_of(259) == "bpe" and v.token_of(999) is None and v.id_of(b"zz") is None
    with pytest.raises(KeyError):
        v.special_id("no")
    with pytest.raises(KeyError):
        v.special_token(9)
    m = Merges()
    m.record(3, 4, 259, 7)
    assert m.rank_of(3, 4) == 0 and m.rank_of(4, 3) == -1
    with pytest.raises(IndexError):
        m.at(1)
    assert Merges.from_json(m.to_json()) == m
    again = Vocabulary.from_json(json.loads(json.dumps(v.to_json())), v.special_tokens)
    assert again.tokens == v.tokens


def test_files(spark, tmp_path):
    t = _trained(CORPORA[0], Config(vocab_size=259 + 8))
    t.save(tmp_path / "t")
    assert checks.validate_tokenizer(tmp_path / "t")["is_valid"]
    back = Tokenizer.load(str(tmp_path / "t"))
    assert back.merges == t.merges and back.vocabulary.tokens == t.vocabulary.tokens and back.config == t.config
    first = t.inspect_merges(spark, 2).orderBy("rank").collect()
    assert first[0]["new_bytes"] == first[0]["left_bytes"] + first[0]["right_bytes"] and len(first) == 2
    (tmp_path / "t" / "merges.json").write_text('[{"rank": 1, "left": 9999, "right": 3, "new_token_id": 4, "frequency": -1}]')
    (tmp_path / "t" / "tokenizer.json").unlink()
    bad = checks.validate_tokenizer(tmp_path / "t")
    assert not bad["is_valid"] and len(bad["errors"]) == 4
    (tmp_path / "t" / "vocab.json").write_text("{")
    assert any("vocab.json" in e for e in checks.validate_tokenizer(tmp_path / "t")["errors"])
