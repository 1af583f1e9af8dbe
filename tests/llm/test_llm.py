"""The ten operators and the pipeline against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, langid, lm, mixing, neardup, pii, quality, substring, tokens
from folioflow.llm import queries as q

from ..conftest import SMALL

DOC = "doc_id bigint, text string"
FULL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PASSAGE = " ".join(f"w{i}é" for i in range(80))
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "One"), (-5, "x " + PASSAGE + " y"), (-5, "x " + PASSAGE + " y"), (-6, "z " + PASSAGE), (None, PASSAGE), (-7, "a " * 120), (-8, "long " * 30_000), (-9, "\nA line here\n\n A  LINE here \n"), (-10, PASSAGE.upper())]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, DOC)).repartition(3).cache()


@pytest.fixture(scope="module")
def full(spark):
    odd = spark.createDataFrame([(d, t, None, None if d and d % 2 else "src1", 5) for d, t in ODD], FULL)
    return spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(odd).withColumn("_x", F.lit(1)).withColumn("kept", F.lit("clash")).withColumn("taken", F.lit(7)).cache()


def empty(spark, schema=DOC):
    return spark.createDataFrame([], schema)


def test_token_counts(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = Counter(map(tuple, tokens.count_tokens(docs, str(tmp_path / "c"), path).collect()))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert got == want
    stored = spark.read.parquet(str(tmp_path / "c"))
    n = stored.count()
    assert n == len({r.text or "" for r in docs.collect()})
    again = tokens.count_tokens(docs.unionByName(spark.createDataFrame([(1, "brand new <|endoftext|>")], DOC)), str(tmp_path / "c"), path)
    assert again.count() == docs.count() + 1 and spark.read.parquet(str(tmp_path / "c")).count() == n + 1
    other = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert tokens.count_tokens(docs.limit(5), str(tmp_path / "c"), other).count() == 5
    assert tokens.count_tokens(empty(spark), str(tmp_path / "e"), path).count() == 0


def test_template_language():
    render = lambda t, m=(), **k: "".join(p for p, _ in chat.compile_template(t)(m, **k))
    assert chat.parse("a{{ 'b' ~ (1 + 2) }}c{% if 'x' == 'x' %}d{% else %}e{% endif %}") == [("text", "ab3cd")]
    assert chat.parse("a{% if true and not false %}d{% else %}e{% endif %}{{ ' q ' | trim | upper }}") == [("text", "adQ")]
    assert render("{% for m in messages %}{{ loop.index }}{% if loop.last %}!{% elif loop.first %}<{% endif %}{{ m.text }}{% endfor %}", [{"text": "a"}, {"text": "b"}, {"text": "c"}]) == "1<a2b3!c"
    assert render("{% set x = 'k' %}{{ x }}{{ missing }}{{ y.z }}", y={"z": 5}) == "k5"
    pieces = list(chat.compile_template("a{% generation %}{{ t }}{% endgeneration %}b")((), t="T"))
    assert pieces == [("a", False), ("T", True), ("b", False)]
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{% import os %}", "{{ x | open }}", "{% if x %}", "{{ 1 +* 2 }}", "{{ 'b' + 1 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


@pytest.mark.parametrize("part", [3, 1 << 20])
def test_chat_round_trip(spark, part):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n", "<turn user>\n", "\\", "<\\turn", "", None, "<", "<\\\\/turn>", "é" * 5]
    rows = [(i // 3, i % 3, ["user", "assistant", None, "a>b\n<turn "][i % 4], t) for i, t in enumerate(hard * 3)] + [(None, 0, "assistant", "n"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d, part=part)).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or "", role is None, text is None))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], not t[3], t[1], not t[4], t[2]))
        said = "".join(t[2] for t in turns if t[1] == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{t[1]}\n{t[2]}\n" for t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert chat.format_conversations(empty(spark, "conv_id bigint, turn bigint, role string, text string")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_lm(spark, docs, monkeypatch, small):
    if small:  # several filter shards, and most words in the tail
        monkeypatch.setattr(lm, "MAX_FILTER", 30_000)
        monkeypatch.setattr(lm, "HEAD", 200)
    rows = docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for r in rows if not held(r.doc_id) for w in toks(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, len(k := toks(r.text)), sum(c[w] > 0 for w in k), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k), 4)) for r in rows)
    out = lm.score(docs, docs.where(~lm.held_out(F.col("doc_id"))).select("text")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    seen = [r for r in out if not held(r.doc_id)]
    assert all(r.score < 0 for r in out) and sum(r.score for r in seen) > sum(r.base_score for r in seen)
    fresh = [r for r in out if held(r.doc_id)]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_lm_hot_word(spark, monkeypatch):
    """A word that makes a third of all tokens, with ever new followers, fills no segment more than others."""
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 14)
    real, sizes = lm.build_filter, []

    def spy(counts, *rest):
        built = real(counts, *rest)
        sizes.extend(r.n for r in built.select(F.length("bits").alias("n")).collect())
        return built

    monkeypatch.setattr(lm, "build_filter", spy)
    train = [" ".join(f"hot {j:x} y{j:x}" for j in range(i, i + 40)) for i in range(0, 12_000, 40)]
    texts = train[:50] + [" ".join(f"hot y{j:x}" for j in range(i, i + 40)) for i in range(0, 4_000, 40)]
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(list(enumerate(texts)), DOC), spark.createDataFrame([(t,) for t in train], "text string")).collect()}
    assert len(sizes) >= 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    want = exact_scores(train, texts)
    assert sum(abs(out[i].score - w) / out[i].n_tokens for i, w in enumerate(want)) / len(texts) < 0.06


@pytest.mark.parametrize("head", [lm.HEAD, 20, 1])
def test_lm_head_does_not_change_the_score(spark, docs, monkeypatch, head):
    """Which words are broadcast is a matter of size; every word keeps its own unigram probability."""
    monkeypatch.setattr(lm, "HEAD", head)
    if head == 20:
        monkeypatch.setattr(lm, "MAX_FILTER", 30_000)
    rare = [f"r{i:x}" for i in range(2_000)]
    train = [" ".join([*rare[i : i + 8], *(f"often{j % 9}" for j in range(i, i + 72))]) for i in range(0, len(rare), 8)]
    texts = train[:20] + [" ".join(rare[i::50]) + " new words" for i in range(50)] * 2
    out = lm.score(spark.createDataFrame([(0 if i > 19 else i, t) for i, t in enumerate(texts)], DOC), spark.createDataFrame([(t,) for t in train], "text string")).collect()
    assert len(out) == len(texts)
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / tokens == pytest.approx(sum(exact_scores(train, texts)) / tokens, abs=0.05)


def test_lm_routed_probes_equal_the_broadcast(spark, docs, monkeypatch):
    """Beyond MAX_FILTER the probes are sent to the shards, batch by batch; the scores are those of the broadcast filter."""
    monkeypatch.setattr(lm, "HEAD", 200)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 14)
    train = docs.where(~lm.held_out(F.col("doc_id"))).select("text")
    scores = lambda: Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, train).collect())
    want = scores()
    monkeypatch.setattr(lm, "MAX_FILTER", 30_000)
    for batch in (1, 50_000, lm.BATCH):
        monkeypatch.setattr(lm, "BATCH", batch)
        assert scores() == want


def test_bloom_counts(spark):
    import numpy as np

    keys = lm.mix(np.arange(1, 2001, dtype=np.uint64))
    counts = np.where(np.arange(2000) % 5 == 0, 9, 1)
    f = lm._blobs(*lm._unique_sum(keys, counts), 2)
    d = spark.createDataFrame(f.to_pandas(), lm.COUNTS)
    data = b"".join(bytes(r.bits) for r in lm.build_filter(d, 1 << 14).orderBy("segment").collect())
    got = lm.Filter(bytearray(data), 0, 1 << 14, 2).counts(keys)
    assert (got >= np.where(counts == 9, 11.5, 1)).all() and (got == np.where(counts == 9, 11.5, 1)).mean() > 0.95
    assert (lm.Filter(bytearray(data), 0, 1 << 14, 2).counts(lm.mix(keys)) == 0).mean() > 0.95
    assert lm.score(empty(spark), empty(spark)).count() == 0


def exact_scores(train, texts):
    """Scores of texts by exact counts, read as the middle of their power-of-two class."""
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    uni, two = Counter(), Counter()
    for t in train:
        k = toks(t)
        uni.update(k)
        two.update(zip([None, *k], k))
    floor = sum(uni.values()) + 0.5 * (len(uni) + 1)
    middle = lambda c: (3 * 2 ** (c.bit_length() - 1) - 1) / 2 if c else 0.0
    one = lambda u, w: math.log10((middle(two[u, w]) + lm.ALPHA * (uni[w] + 0.5) / floor) / (max(middle(uni[u]), middle(two[u, w])) + lm.ALPHA))
    return [sum(one(u, w) for u, w in zip([None, *toks(t)], toks(t))) for t in texts]


def test_lm_unseen_pairs(spark):
    """New orders of known words gain nothing from n-grams that were never stored, though texts of ever new words hold the most n-grams a byte."""
    words = [f"{i:x}" for i in range(20_000)]
    train = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    novel = [" ".join(words[i::500]) for i in range(500)]
    out = lm.score(spark.createDataFrame(list(enumerate(novel)), DOC), spark.createDataFrame([(t,) for t in train], "text string")).collect()
    assert sum(r.score for r in out) / sum(r.n_tokens for r in out) == pytest.approx(sum(exact_scores(train, novel)) / sum(r.n_tokens for r in out), abs=0.06)


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = langid.fit(langid.sample(d.where(~held), 400))
    got = {r.doc_id: r for r in langid.predict(d.where(held), model).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in d.where(held).collect()]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r for r in langid.predict(spark.createDataFrame(ODD + [(-20, "12 34 !!"), (-21, "z")], DOC), model).collect()}
    assert {odd[k].lang_pred for k in (-1, -2, -3, -20)} == {"und"} and odd[-21].lang_pred in model.languages and odd[-20].rejected
    nothing = langid.predict(spark.createDataFrame(ODD, DOC), langid.fit(langid.sample(d.where("false"))))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


@pytest.mark.parametrize("small", [False, True])
def test_substring_dedup(spark, docs, monkeypatch, small):
    if small:  # hot anchors, many automata, many flushes
        for name, value in (("HOT", 1), ("RUNS", 1), ("FLUSH", 300)):
            monkeypatch.setattr(substring, name, value)
    rows, first = docs.collect(), {}
    for r in rows:
        if r.doc_id is not None:
            w = (r.text or "").encode().split()
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, r.doc_id), r.doc_id)
    want = Counter()
    for r in rows:
        w, gone = (r.text or "").encode().split(), set()
        for i in range(len(w) - 49) if r.doc_id is not None else ():
            if first[tuple(w[i : i + 50])] < r.doc_id:
                gone.update(range(i, i + 50))
        want[(r.doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    assert Counter(map(tuple, substring.removed(docs, digest=True).collect())) == want
    assert any(k[2] for k in want)
    if not small:
        assert substring.removed(empty(spark)).count() == 0


def test_suffix_automaton():
    import random

    rng = random.Random(1)
    for _ in range(40):
        passages = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        words = [rng.choice("abc") for _ in range(15)]
        subs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i, len(p) + 1)}
        want = [max(n for n in range(i + 2) if tuple(words[i + 1 - n : i + 1]) in subs or n == 0) for i in range(len(words))]
        assert list(substring.Automaton(passages).statistics(words)) == want
    assert list(substring.spans([1, 2, 3, 3, 1, 1, 2, 3], 3)) == [(0, 4), (5, 8)] and list(substring.spans([1, 2, 3, 3, 1, 2, 3], 3)) == [(0, 7)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii(spark, docs):
    hard = ["a@b.c_d@e.f x@y.z.@q.w 1.2.3.4.5.6.7.8 300.1.1.1 0000001.2.3.004", "4111 1111-1111 1111 +1 (23) 456-7890.12 1.2.3 @ +", "+1 23+4 567 890 1234 5 a@b@c.d..e", "9" * 300 + " " + "a" * 3000 + "@x.yy " + "1." * 200, "é𝒳 q@r.st 4111111111111111"]
    d = docs.unionByName(spark.createDataFrame([(-100 - i, t) for i, t in enumerate(hard)], DOC)).withColumn("start", F.lit("clash"))
    got = pii.find_spans(d, into="f").select("text", pii.span_list(F.filter("f", lambda s: s["order"] < 4)).alias("b")).collect()
    assert all(r.b == base_spans(r.text or "") for r in got) and any(r.b for r in got)
    more = spark.createDataFrame([(1, "pay IBAN GB82 WEST 1234 5698 7654 32 now; ssn 123-45-6789"), (2, "GB82 WEST 1234 5698 7654 33 and 123-45-6789 alone"), (3, None), (4, "mail a@b.cd!")], DOC)
    assert [r.text for r in pii.redact(more).orderBy("doc_id").collect()] == ["pay IBAN [IBAN] now; ssn [SSN]", "GB82 WEST 1234 5698 7654 33 and 123-45-6789 alone", None, "mail [EMAIL]!"]
    assert pii.redact(empty(spark)).count() == 0


def test_iban_before_other_words(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = {f"{gb} BIC MIDLGB22": "[IBAN] BIC MIDLGB22", f"to {gb} 2024 EUR": "to [IBAN] 2024 EUR", f"{de} {gb} OK": "[IBAN] [IBAN] OK", f"NR ZZ12 {gb} X": "NR ZZ12 [IBAN] X", f"{gb}A B": f"{gb}A B", f"{gb[:-1]}3 BIC": f"{gb[:-1]}3 BIC"}
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    assert [r.text for r in pii.redact(d).orderBy("doc_id").collect()] == list(texts.values())


def bench_hits(items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    win = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            win[tuple(w[i : i + n])].add(str(item))
    widths = {len(k) for k in win}

    def find(t):
        w, hit, found = words(t), set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in win:
                    hit.update(range(i, i + n))
                    found |= win[tuple(w[i : i + n])]
        return len(w), len(hit), sorted(found)

    return find


def test_decontamination(spark, docs, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [(901, "Zorp Élan"), (902, None), (903, "!!"), (9, "zorp Élan"), (904, "a a a a a a a a a a a")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = docs.unionByName(spark.createDataFrame([(-30, "x ZORP, Élan? zorp Élan zorp élan"), (-31, "p " * 508 + items[0][1] + " q")], DOC))
    find = bench_hits(items)
    want = Counter(str((r.doc_id, *find(r.text))) for r in d.collect())
    assert Counter(str((r.doc_id, r.n_words, r.n_hit, list(r["items"]))) for r in decontaminate.report(d, b).collect()) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 0)
    assert Counter(str((r.doc_id, r.n_words, r.n_hit, list(r["items"]))) for r in decontaminate.report(d, b).collect()) == want
    c = decontaminate.clean(d.withColumn("key", F.lit("clash")), b, max_share=0.9).collect()
    assert max(find(r.text)[1] for r in c) == 0 and {r.text for r in c if r.doc_id == -30} == {"x zorp élan"}
    assert decontaminate.report(d, b.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.report(empty(spark), b).count() == 0


def test_quality(spark, full):
    got = Counter(map(tuple, quality.verdicts(full).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    want = Counter()
    for r in full.collect():
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        runs = list(zip(w, w[1:], w[2:]))
        n, marked = Counter(runs), set()
        for i, k in enumerate(runs):
            if n[k] > 1:
                marked |= {i, i + 1, i + 2}
        want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w))] += 1
    assert got == want
    assert quality.verdicts(full.limit(0)).count() == 0


def test_quality_lines(spark):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    rows = [(i, f"{own(i)}\n Boiler  PLATE line", "h") for i in range(40)] + [(100 + i, "boiler plate line\n" + "filler common words " * 3 + own(0), "h") for i in range(3)]
    rows += [(200, own(200) + "\nBoiler plate line", "other"), (300, "\n".join(["boiler plate line"] * 30) + "\n" + own(3)[:40], "h")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    v = {r.doc_id: r for r in quality.verdicts(d, min_docs=5).collect()}
    assert v[0].n_removed_words == 0 and v[1].n_removed_words == 3 and v[1].kept and v[200].n_removed_words == 0 and not v[300].kept
    c = {r.doc_id: r.text for r in quality.clean(d, min_docs=5).collect()}
    assert c[1] == own(1) and c[0].endswith("line") and 300 not in c and c[200].endswith("line")
    copies = spark.createDataFrame([(i, own(1) + "\ncopied line", "h") for i in range(30)], "doc_id bigint, text string, source string")
    assert quality.verdicts(copies, min_docs=5).where("kept").count() == 30  # copies of one text count once


def test_quality_limit_of_hosts_of_any_size(spark):
    """A line in 50 distinct texts of its host stays, one in 51 goes from all but the first, on a large host and a small one."""
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(50))
    said = lambda i: ("\nstays in fifty" if i < 50 else "") + ("\ngoes with one more" if i < 51 else "")
    rows = [(i, own(i) + said(i), "large") for i in range(3_000)] + [(10_000 + i, own(-i) + said(i), "small") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    gone = {r.doc_id: r.n_removed_words for r in quality.verdicts(d).where("n_removed_words > 0").collect()}
    assert gone == {**{i: 4 for i in range(1, 51)}, **{10_000 + i: 4 for i in range(1, 51)}}
    kept = {r.doc_id: r.text for r in quality.clean(d).collect()}
    assert len(kept) == 3_100 and kept[5] == own(5) + "\nstays in fifty" and kept[0].endswith("one more") and kept[10_005] == own(-5) + "\nstays in fifty"


def test_quality_odd_rows(spark):
    """clean: nulls, empty table, repeated rows, a clashing column, a hot line that holds most rows."""
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    rows = [(None, own(1), None, 1), (2, None, "h", 2), (3, "", "h", 3), (4, own(4), None, 4), (4, own(4), None, 4), (5, " ".join(own(5000 + k) for k in range(50)), "h", 5)] + [(100 + i, own(100 + i) + "\nhot", "h", 6) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, line int")
    got = Counter((r.doc_id, r.line) for r in quality.clean(d).collect())
    assert got[None, 1] == 1 and got[4, 4] == 2 and got[5, 5] == 1 and not got[2, 2] and not got[3, 3] and sum(got.values()) == 304
    assert sum(r.text.endswith("hot") for r in quality.clean(d).where("line = 6").collect()) == 1
    assert quality.clean(d.limit(0)).count() == 0 and quality.clean(d).columns == d.columns


def test_language_sample_is_bounded(spark):
    """Rows that share an id or have none are drawn by their texts; equal rows are one."""
    many = spark.range(3_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit(1).alias("draw"))
    assert 150 < len(langid.sample(many, 200)) <= 200
    assert len(langid.sample(many.limit(50), 200)) == 50 and len(langid.sample(many.limit(5).crossJoin(spark.range(400)).drop("id"), 3)) == 3
    assert langid.sample(many.limit(0)) == [] and [r[1].tolist() for r in langid.sample(many, 20)] == [r[1].tolist() for r in langid.sample(many.repartition(7), 20)]
    odd = spark.createDataFrame([(1, None, "en"), (2, "x", None), (3, "", "en"), (3, "", "en")], "doc_id bigint, text string, lang string")
    assert len(langid.sample(odd)) == 1


def test_mixing(spark, full):
    sizes = mixing.sizes_of(full)
    out = mixing.plan(sizes).collect()
    again = mixing.plan(mixing.sizes_of(full)).collect()
    assert Counter(map(str, out)) == Counter(map(str, again)) and len(out) == full.count()
    size, take, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        take[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(size.values()), set(names)
    while over := [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            want[s] = 2 * size[s]
        free -= set(over)
        left = 1.5 * sum(size.values()) - sum(want.values())
    total = sum(weight[x] for x in free)
    want |= {s: weight[s] * left / total for s in free}
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(take[s] - target[s]) <= max(3, 0.01 * target[s])
    assert mixing.plan(mixing.sizes_of(full.limit(0))).count() == 0
    m = mixing.mix(full)
    assert m.columns == [*full.columns, "_ff_taken"] and m.count() > 0


def test_sainte_lague(spark):
    votes = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0), ("e", 1.0)]
    d = spark.createDataFrame([(n, p, v, s) for n in range(12) for p, v in votes for s in [n * 3]], "g int, party string, votes double, seats bigint")
    got = {(r.g, r.party): r.won for r in mixing.apportion(d, ["g"], [F.col("party")], "votes", "seats", "won").collect()}
    for n in range(12):
        bids = sorted(((-v / (2 * a + 1), p) for p, v in votes if v for a in range(40)))[: n * 3]
        assert {p: got[n, p] for p, _ in votes} == {p: sum(x[1] == p for x in bids) for p, _ in votes}


def grams(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))


def near(rows):
    g, inv, pairs = [grams(r.text) for r in rows], defaultdict(list), Counter()
    for i, s in enumerate(g):
        for x in s:
            inv[x].append(i)
    for own in inv.values():
        for a in range(len(own)):
            for b in range(a):
                pairs[own[b], own[a]] += 1
    root, links = list(range(len(rows))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), c in pairs.items():
        if c >= 0.8 * (len(g[a]) + len(g[b]) - c):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    return [find(i) for i in range(len(rows))], links


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = [f"t{i}" for i in range(120)]
    group = [(5000 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(8)]
    d = docs.unionByName(spark.createDataFrame(group, DOC)).withColumn("node", F.lit("clash"))
    rows = d.collect()
    cls, links = near(rows)
    name = {}
    for i, c in enumerate(cls):
        if rows[i].doc_id is not None:
            name[c] = min(name.get(c, rows[i].doc_id), rows[i].doc_id)
    want = Counter((r.doc_id, name.get(cls[i]), links[i]) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.classes(d).collect()) == want
    kept = neardup.representatives(d).collect()
    blank = sum(not grams(r.text) for r in rows)
    assert len(kept) == len({c for i, c in enumerate(cls) if grams(rows[i].text)}) + blank and kept[0].__fields__ == d.columns
    if block == 512:
        assert neardup.classes(empty(spark)).count() == 0


def test_components(spark):
    import random

    from folioflow.llm.graph import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (200, 201), (201, 200)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in linked}


def test_banding():
    bands, rows = neardup.choose()
    assert 1 - (1 - 0.8**rows) ** bands >= neardup.RECALL and bands * rows <= neardup.MAX_HASHES


def test_queries_and_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in q.ORACLES.items():
        df = q.QUERIES[name](spark, SMALL)
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        keep = [c for c in cols]
        tidy = lambda r: str([(c, round(r[c], 6) if isinstance(r[c], float) else r[c]) for c in sorted(keep)])
        assert sorted(df.columns) == sorted(cols)
        assert sorted(tidy(r.asDict()) for r in df.collect()) == sorted(tidy(dict(zip(cols, r))) for r in cur.fetchall()), name
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q.QUERIES) == 1


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, kept = docs.collect(), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    want = set()
    for r in before:
        w = WORD.findall(r.text or "")
        runs = list(zip(w, w[1:], w[2:]))
        n, marked = Counter(runs), set()
        for i, x in enumerate(runs):
            if n[x] > 1:
                marked |= {i, i + 1, i + 2}
        if len(w) >= 50 and 100 * len(marked) <= 50 * len(w):
            want.add(r.doc_id)
    assert set(kept[0]) == want  # no host of the small tables has enough documents for boilerplate
    rows = sorted(kept[0].values(), key=lambda r: r.doc_id)
    cls, _ = near(rows)
    first = {}
    for r, c in zip(rows, cls):
        first.setdefault(c, r.doc_id)
    assert set(kept[1]) == set(first.values())
    find = bench_hits([(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    assert set(kept[2]) == {d for d, r in kept[1].items() if find(r.text)[1] <= 0.5 * find(r.text)[0]} and all(find(r.text)[1] == 0 for r in kept[2].values())
    assert set(kept[3]) == set(kept[2]) and not any(base_spans(r.text or "") for r in kept[3].values())
    assert set(kept[4]) <= set(kept[3]) and all(0 < r.taken <= 2 * len(WORD.findall(r.text)) for r in kept[4].values())
    assert {r.doc_id: r.taken for r in cp.run(spark, SMALL).collect()} == {d: r.taken for d, r in kept[4].items()}
