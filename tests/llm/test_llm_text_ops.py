"""Row-local operators against plain Python versions."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_cases import base_counts, hits

from quire.llm import bpe, decontaminate, mil, pii, quality_rules
from quire.llm.words import NOT_SPACE, cut_words


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_equals_the_library(name):
    ranks = bpe.read_ranks(public_tokenizers.path(name))
    ours = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd, tokens = random.Random(3), list(ranks)
    for i in range(1500):
        kind = i % 4
        if kind == 0:
            s = "".join(rnd.choice("abcdeéß \n\x1c\x85") for _ in range(rnd.randint(0, 40)))
        elif kind == 1:
            s = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 8))).decode("utf8", "replace")
        elif kind == 2:
            s = rnd.choice("aA0 !=-é") * rnd.randint(1, 300)
        else:
            s = "".join(chr(rnd.choice([rnd.randint(0, 126), rnd.randint(0x80, 0x24F), rnd.randint(0x4E00, 0x5000), rnd.randint(0x1F600, 0x1F640)])) for _ in range(30))
        ids = ours.encode(s).tolist()
        assert ids == theirs.encode_ordinary(s) and ours.decode(ids) == s.encode()


def test_bpe_round_trip_on_spark(spark, tiny):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(50)
    ids = bpe.encode_texts(docs, path, pattern)
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode_ids(ids, path).collect()}
    digests = {r["doc_id"]: r for r in bpe.op3_bpe(docs).collect()}
    packed = {r["doc_id"]: np.array(r["ids"], "<u4").tobytes() for r in ids.collect()}
    for r in docs.collect():
        d = digests[r["doc_id"]]
        assert back[r["doc_id"]] == r["text"].encode()
        assert d["ids_sha256"] == hashlib.sha256(packed[r["doc_id"]]).hexdigest() and d["n_tokens"] * 4 == len(packed[r["doc_id"]])
        assert d["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_memo_forgets_without_effect(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tok = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    text = "several different words, several times different words"
    assert tok.decode(tok.encode(text)).decode() == text and len(tok.pieces) <= 3


def plain_spans(text):
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    for kind, pattern in rules:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, m.start(), m.end()


def test_pii_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    for i in range(20000):
        letters = "ab@@..--0159 +()_é%" if i % 2 else "0123456789012345 -.+4"
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == list(plain_spans(text)), text


def test_pii_added_spans_keep_clear_of_all_base_spans():
    rnd = random.Random(11)
    parts = ["GB82 WEST 1234 5698 7654 32", "phone 030 1234567", "call +49 30 1234567", "a.b@x1.de", "4111 1111 1111 1111", "10.0.0.1", "ssn 123-45-6789", "x", "DE89370400440532013000@x.de"]
    added = 0
    for _ in range(300):
        text = rnd.choice(["", " ", "; "]).join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12)))
        base = [(a, b) for _, a, b in pii.base_spans(text)]
        more = [(k, a, b) for k, a, b, _ in pii.find(text) if k in pii.ADDED]
        assert all(b <= x or y <= a for _, a, b in more for x, y in base), text
        # A kind's matches that touch no base span and score enough are all kept.
        for kind, pattern in zip(pii.ADDED[1:], (pii._NATIONAL, pii._LOCAL_PHONE), strict=True):
            want = [(m.start(), m.end()) for m in pattern.finditer(text) if all(m.end() <= x or y <= m.start() for x, y in base)]
            want = [(a, b) for a, b in want if pii.score(kind, text, a, b) >= pii.MIN_SCORE]
            assert [(a, b) for k, a, b in more if k == kind] == want, text
        added += len(more)
    assert added > 50


def test_pii_time_grows_with_the_text():
    import time

    def took(n: int) -> float:
        text = "phone 030 1234567 mail a@b.de; " * n
        start = time.perf_counter()
        pii.find(text)
        return time.perf_counter() - start

    took(100)
    assert min(took(16000) for _ in range(2)) < 10 * max(took(4000) for _ in range(2))


def test_pii_method_adds_confirmed_spans(spark):
    texts = [
        "account DE89370400440532013000 is mine", "account DE89370400440532013001 is mine", "my ssn is 123-45-6789", "part 123-45-6789 of the plan",
        "call 555-123-4567 now", "sum 555-123-4567 now", "GB82 WEST 1234 5698 7654 32 AND more", "ü mail: a.b@c.de, +1 (487) 555-7209, 1.2.3.4, 4736962573099581",
    ]
    kinds = [[s[0] for s in pii.find(t)] for t in texts]
    assert kinds[:7] == [["iban"], [], ["national_id"], [], ["local_phone"], [], ["iban"]]
    assert pii.find(texts[6])[0][1:3] == (0, 27)
    row = pii.op10_pii(spark.createDataFrame([(1, texts[7])], "doc_id long, text string")).first()
    assert row["spans"] == "email:8:16,ip:37:44,card:46:62,phone:18:35" and row["n_card"] == row["n_phone"] == 1 and row["n_email"] == 1 and row["n_ip"] == 1
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[7]))
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_pii_is_linear():
    assert pii.base_spans("a" * 300000 + "@") == [] and pii.base_spans("1" * 300000) == [] and len(pii.base_spans("a" * 200000 + "@b.c")) == 1


def random_words(rnd, n, letters="abcde"):
    return " ".join(rnd.choice(letters) for _ in range(n))


def test_decontaminate_equals_plain_search(spark, monkeypatch):
    rnd = random.Random(2)
    items = [(i, random_words(rnd, rnd.choice([0, 1, 3, 9, 10, 14, 30]), "abcdE")) for i in range(25)] + [(3, random_words(rnd, 12))]
    docs = []
    for d in range(120):
        t = random_words(rnd, rnd.randint(0, 40), "abcdefghijklm")
        if d % 3 == 0:
            t += " " + rnd.choice(items)[1].upper() + ". " + random_words(rnd, rnd.randint(0, 9), "abxyz")
        docs.append((d, t if d % 17 else None))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    long_items = [(n, t) for n, t in items]
    for shard, block in ((4_000_000, 32_000_000), (300, 200)):
        monkeypatch.setattr("quire.llm.words.SHARD_BYTES", shard)
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = {r["doc_id"]: r for r in decontaminate.op2_decontaminate(frame, bench).collect()}
        for d, t in docs:
            n, hit, names = hits(t, long_items)
            want = (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
            assert tuple(got[d])[1:] == want, (d, t, tuple(got[d]), want, names)
        kept = {r["doc_id"] for r in decontaminate.remove_contaminated(frame, bench).collect()}
        assert kept == {d for d, t in docs if not hits(t, long_items)[1]}


def test_suffixes_that_end_at_the_packed_width_come_first():
    rnd = random.Random(7)
    items = [(str(i), " ".join(f"v{rnd.randint(0, 1500)}" for _ in range(40))) for i in range(60)]
    index = decontaminate.index_items(items)
    assert 62 // len(index["vocabulary"]).bit_length() == 5 and len(index["vocabulary"]) > 1000
    texts = []
    for _, t in items:
        w = t.split()
        for _ in range(12):
            a, n = rnd.randint(0, 25), rnd.choice([4, 5, 6, 9, 10, 11, 15])
            texts.append(" ".join([*w[a : a + n], "other", *w[: rnd.choice([5, 10, 20])], "changed", *w[20:25]]))
    rnd.shuffle(texts)
    raw = [t.encode() for t in texts]
    got = decontaminate.scan_shard(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), index)
    for d, t in enumerate(texts):
        _, hit, names = hits(t, items)
        assert sum(b - a for a, b in got["spans"].get(d, [])) == hit
        assert sorted(index["names"][k] for k in got["items"].get(d, ())) == sorted(names)
    words = np.array([1, 2, 3, 4, 5, 6, 0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 3, 4, 5, 0] + [0] * 12)
    places = decontaminate.suffix_array(words, 10, 1033)
    cut = [words[p : p + list(words[p:]).index(0)].tolist() for p in places]
    assert cut == sorted(cut)


def test_one_block_of_the_benchmark_is_alive(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    alive, most, made = set(), [], []
    make, destroy = SparkContext.broadcast, Broadcast.destroy

    def counted(self, value):
        out = make(self, value)
        made.append(out)
        alive.add(id(out))
        most.append(len(alive))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (alive.discard(id(self)), destroy(self, *a))[1])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(8)]
    docs = spark.createDataFrame([(i, t if i % 2 else f"clean text {i}") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.op2_decontaminate(docs, bench).where("contaminated").collect()) == [1, 3, 5, 7]
    assert max(most) == 1 and len(made) > 2


def test_longest_matches_equal_plain_search(spark):
    rnd = random.Random(4)
    items = [(i, random_words(rnd, 15, "abc")) for i in range(4)]
    docs = [(d, random_words(rnd, 40, "abcd")) for d in range(12)]
    got = {(r["item_id"], r["offset"]): r["n_words"] for r in decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for name, t in items:
        w = t.split()
        for o in range(len(w)):
            best = max(next((k for k in range(len(w) - o, 0, -1) if f" {' '.join(w[o : o + k])} " in f" {x} "), 0) for _, x in docs)
            assert got.get((str(name), o), 0) == best


def test_cut_words():
    texts = ["Ab aB  c", "", "é x", "ab"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, start, stop, counts = cut_words(np.frombuffer(b"".join(raw), np.uint8), offsets, {}, NOT_SPACE)
    assert counts.tolist() == [3, 0, 2, 1] and h[0] == h[1] == h[5] and len(set(h.tolist())) == 4 and (stop - start).tolist() == [2, 2, 1, 2, 1, 2]


def test_quality_counts(spark):
    rnd = random.Random(6)
    texts = [None, "", " ", "a b c a b c", "a a a a", "A\nA \nB\n\n b|c <é>", " ".join(["x"] * 9)]
    texts += [" ".join(rnd.choice("abcÀd") for _ in range(rnd.randint(0, 60))).replace(" ", rnd.choice([" ", "\n", " \t"])) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.with_stats(frame).collect():
        assert tuple(r["_stats"]) == base_counts(r["text"]), r["text"]


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(10, 0), (50, 2), (400, 1), (1000, 9), (30, 29), (0, 0)]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules._tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect()
    for r in rows:
        exact = sum(comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == 1.0 if r["k"] >= 0.05 * r["n"] else abs(r["p"] - exact) < 1e-9


def test_risk_control(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(6000):
        good = i % 8 > 1
        symbols = rnd.choice([0, 0, 1, 2]) if good else rnd.choice([0, 40])
        rows.append((i, " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(60)) + " " + "#" * symbols * 4, "en" if i < 5900 else None, int(good)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs, labels).collect()}
    wrong = [r[0] for r in rows if r[3] and r[0] not in kept]
    caught = [r[0] for r in rows if not r[3] and r[2] and "####" * 40 in r[1] and r[0] not in kept]
    assert len(wrong) <= 0.04 * 4500 and len(caught) > 600
    assert all(r[0] in kept for r in rows if r[2] is None), "a stratum with too few labels has no cutoff"


def test_mil_gradient():
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(9, mil.N_FEATURES)), np.array([1, 3, 5]), np.array([0.0, 1.0, 1.0])
    model = mil.fit(x, bags, y)
    grads = mil._gradients(model, x, bags, y)

    def loss(m):
        p = mil.forward(m, x, bags)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + mil.DECAY / 2 * sum((m[k] ** 2).sum() for k in grads)

    for key in grads:
        at = tuple(rng.integers(0, s) for s in model[key].shape)
        up, down = ({**model, key: model[key].copy()} for _ in range(2))
        up[key][at] += 1e-5
        down[key][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - grads[key][at]) < 1e-6


def test_mil_held_out_accuracy(spark, tiny):
    folder = tiny.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = mil.op7_quality_mil(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
