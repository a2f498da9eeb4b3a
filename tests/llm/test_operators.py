"""Corpus operators against plain versions, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, isomedia, langid, lm, mixing, neardup, pii, queries, suffixdedup, topk, warczip

LONG = "x1 " * 20_000
TEXTS = [None, "", " \t\n", "one", "one two", "The Same words here again", "the same WORDS here again", "a" * 30_000, LONG, "1" * 5000 + " +1 (555) 123-4567 a@b.co c@d.e_f@g.hi", "mail bob@x.example.com ip 10.0.0.255 1.2.3.256 card 4111 1111 1111 1111 4111 1111 1111 1112", "héllo wörld 你好 🙂 bob@x.org", "call 988-555-2485 or (988) 555-2485 now"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i else None, len(t or ""), "clash") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "src0", 25, "clash"), (None, "a null id here", None, "src1", 14, "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def test_pii_base_spans(spark, docs, empty):
    spans = lambda found: Counter((r.id, tuple((s.k, s.start, s.end) for s in r.base)) for r in found.collect())
    assert spans(pii.find_pii(docs)) == Counter((r.doc_id, tuple(plain_spans(r.text or ""))) for r in docs.collect())
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0
    r = random.Random(8)
    many = [(i, " ".join(r.choice(["a@b.co", "1.2.3.4", "4111111111111111", "+1 555 123 4567", "né", "x"]) for _ in range(400))) for i in range(3)]
    d = spark.createDataFrame(many, "doc_id bigint, text string")  # more hits than a block of running sums
    assert spans(pii.find_pii(d)) == Counter((i, tuple(plain_spans(t))) for i, t in many)


def test_pii_redaction_keeps_rows_and_columns(docs):
    odd = docs.withColumn("hits", F.lit(1)).withColumn("spans", F.lit(2))
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[7] == TEXTS[7]
    assert texts[11] == "héllo wörld 你好 🙂 <email>"
    assert not plain_spans(texts[10]) or all(k != 0 for k, *_ in plain_spans(texts[10]))


def test_pii_expectation_maximisation_recovers_planted_reliabilities(spark):
    r = random.Random(1)
    right, wrong = (0.9, 0.8, 0.75, 0.7, 0.85), (0.05, 0.1, 0.1, 0.15, 0.1)
    rows = []
    for _ in range(20_000):
        true = r.random() < 0.4
        rows.append(tuple((1 if true else -1) if (x := r.random()) < a else (-1 if true else 1) if x < a + b else 0 for a, b in zip(right, wrong)) + (1,))
    pi, t = pii.reliabilities(spark.createDataFrame(rows, ", ".join(f"{v} int" for v in pii.VOTES) + ", n int"))
    assert abs(pi - 0.4) < 0.02
    for j, (a, b) in enumerate(zip(right, wrong)):
        no, yes = t[j * 6 : j * 6 + 3], t[j * 6 + 3 : j * 6 + 6]
        assert abs(yes[2] - a) < 0.03 and abs(yes[0] - b) < 0.03 and abs(no[0] - a) < 0.03 and abs(no[2] - b) < 0.03


def test_pii_added_spans_are_right(spark):
    r = random.Random(3)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 8)))
    rows, planted = [], {}
    for i in range(300):
        before = " ".join(word() for _ in range(10)) + " "
        good = r.choice([f'token = "{hexa(40)}"', f"api_key: {hexa(32)}", f"password={hexa(10)}Zq9{hexa(8)}"])
        bad = r.choice(["token = example", "password: changeme", "secret: garden", "token = yyyyyy"])
        rows.append((i, before + (good if i % 3 == 0 else bad if i % 3 == 1 else f"mail {word()}@{word()}.com") + " " + word()))
        if i % 3 == 0:
            planted[i] = (len(before), len(before) + len(good))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x.id: [(s.start, s.end) for s in x.added] for x in pii.find_pii(d).collect()}
    hits = sum(planted[i] in found[i] for i in planted)
    given = sum(map(len, found.values()))
    assert hits >= 0.95 * len(planted) and hits >= 0.9 * given


def test_media_roundtrip(docs, empty):
    got = isomedia.media_features(isomedia.store_media(docs)).collect()
    assert len(got) == docs.count() and isomedia.media_features(isomedia.store_media(empty)).count() == 0
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        payload = isomedia.pad((t or "").encode())
        r = by[i]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.codec == "raw " and r.key_ranges[0].end - r.key_ranges[0].start == 64


def test_media_of_foreign_and_damaged_files():
    from struct import pack

    good = isomedia.write_media(isomedia.pad(b"x" * 1000))
    at = good.index(b"stsz")
    compact = pack(">4sIxxxBI", b"stz2", 0, 8, 16) + bytes([64] * 16)
    size = pack(">I", 4 + len(compact))
    # the sizes box again in its compact form; a shorter or longer movie box moves the payload, so offsets follow
    change = 4 + len(compact) - 20
    foreign = bytearray(good[: at - 4] + size + compact + good[at + 16 :])
    for box in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        p = foreign.index(box) - 4
        foreign[p : p + 4] = (int.from_bytes(foreign[p : p + 4], "big") + change).to_bytes(4, "big")
    p = foreign.index(b"stco") + 12
    foreign[p : p + 4] = (int.from_bytes(foreign[p : p + 4], "big") + change).to_bytes(4, "big")
    a, b = isomedia.read_media(good)[0], isomedia.read_media(bytes(foreign))[0]
    assert a["samples"] == b["samples"] == 16 and good[slice(*a["ranges"][0])] == bytes(foreign)[slice(*b["ranges"][0])]
    huge = good[: at + 12] + (0xFFFFFFF0).to_bytes(4, "big") + good[at + 16 :]
    with pytest.raises(ValueError):
        isomedia.read_media(huge)
    for cut in (10, 40, 200, 400):
        try:
            isomedia.read_media(good[:cut])
        except (ValueError, IndexError, KeyError):
            pass


def test_language_keeps_clean_text_and_reads_pages(spark, docs, empty):
    en, de = "the cat and the dog were in the house with all of them ", "der hund und die katze waren mit allen in dem haus "
    rows = [(i, (en, de)[i % 2] * 5, ("en", "de")[i % 2], "h.de" if i % 2 else "h.com") for i in range(40)] + [(100, de, None, "h.de"), (101, "", "en", "h.com"), (102, None, None, None), (103, "12 34 ###", "en", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, host string")
    got = {r.doc_id: r for r in langid.identify(d, F.col("text"), F.col("lang"), F.col("host")).collect()}
    assert got[100].lang_pred == "de" and not any(got[i].rejected for i in range(40)) and all(got[i].rejected for i in (101, 102, 103))
    assert langid.identify(empty, F.col("text"), F.col("lang"), F.col("source")).count() == 0
    html = spark.createDataFrame([("<html class='a' LANG=\"fr-CA\"><p>x</p>", "https://u@www.Site.fr:80/a")], "html string, url string")
    r = html.select(langid.markup_language(F.col("html")).alias("l"), langid.suffix_of(langid.host_of(F.col("url"))).alias("s"), langid.visible_text(F.col("html")).alias("t")).first()
    assert (r.l, r.s, r.t.strip()) == ("fr", "fr", "x")


HELD_OUT = [
    ("el", "Η γάτα και ο σκύλος ζουν μαζί στο παλιό σπίτι δίπλα στη θάλασσα."),
    ("el", "Το παλιό σπίτι στη θάλασσα είναι μικρό και η γάτα ζει μαζί με τον σκύλο."),
    ("ko", "오늘 아침에는 비가 많이 와서 학교에 늦게 도착했습니다."),
    ("pl", "W zeszłym roku żółte liście spadały z drzew aż do późnej jesieni."),
    ("en", "Yesterday my neighbour borrowed a wheelbarrow and never brought it back."),
]


def test_language_keeps_held_out_sentences(spark):
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    r = random.Random(5)
    noise = ["".join(chr(r.randrange(33, 0x2FF)) for _ in range(300)) for _ in range(3)]
    rows = [(-1 - i, t, lang, None) for i, (lang, t) in enumerate(HELD_OUT)] + [(-100 - i, t, None, None) for i, t in enumerate([HELD_OUT[1][1] + HELD_OUT[0][1], *noise])]
    d = prose.unionByName(spark.createDataFrame(rows, prose.schema))
    got = {x.doc_id: x for x in langid.identify(d, F.col("text"), F.col("lang"), F.col("source")).where("doc_id < 0").collect()}
    assert len(got) == len(rows) and not any(got[-1 - i].rejected for i in range(len(HELD_OUT)))
    assert [got[i].text_lang for i in (-1, -2, -100)] == ["el"] * 3 and got[-1].lang_pred == "el" and not got[-100].rejected
    assert all(got[-101 - i].rejected for i in range(len(noise)))


def test_language_weighs_hidden_and_wrong_declarations(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = F.when(F.col("lang") == "en", "de").otherwise("en")
    hidden = d.select("doc_id", "text", "source", F.col("lang").alias("truth"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 10 == 1), wrong).when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("lang"))
    got = langid.identify(hidden, F.col("text"), F.col("lang"), F.col("source")).join(hidden.select("doc_id", "truth"), "doc_id")
    row = got.agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("int")).alias("right"), F.sum(F.col("rejected").cast("int")).alias("gone")).first()
    assert row.right > 0.98 and row.gone == 0
    long = spark.createDataFrame([(f"<html {'x=1 ' * 500} lang=de><p>x</p>",)], "html string")
    assert long.select(langid.markup_language(F.col("html"))).first()[0] == "de"


def test_language_sums_are_bounded_in_memory(monkeypatch):
    import numpy as np

    texts = [b"", b"abc", b"the cat and the dog " * 50, b"x"]
    table = np.random.default_rng(0).normal(size=((1 << langid.BITS) + 1, 3)).astype(np.float32)
    table[-1] = 0
    bucket, start, n = langid.trigrams(texts)
    want = np.array([table[bucket[s : s + k]].astype(float).sum(axis=0) for s, k in zip(start, n)])
    for cells in (1 << 21, 1):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.allclose(langid.summed(table, bucket, start, n), want)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width,threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates_match_brute_force(spark, docs, width, threshold, monkeypatch):
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 8)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = list(TEXTS)
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(120)] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, uid string")
    sets, root = [shingles(t, width) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= round(100 * threshold) * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r for r in neardup.near_duplicates(d, width=width, threshold=threshold).collect()}
    assert {i: got[i].component_id for i in got} == {i: find(i) for i in range(len(texts))}
    assert all(got[i].n_shingles == len(sets[i]) for i in got)


def test_near_duplicates_with_null_and_repeated_ids(docs, empty):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    same = [r for r in got if r.doc_id in (5, 6)]
    assert {r.component_id for r in same} == {5} and sum(r.first for r in same) == 1
    assert neardup.near_duplicates(empty).count() == 0


def test_language_model_base_and_lattice(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.where("doc_id is not null").collect()
    train = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            train.update((r.text or "").encode().lower().split() + ["END"])
    total, kinds = sum(train.values()), len(train)
    got = lm.corpus_scores(docs.where("doc_id is not null"), path).collect()
    assert len(got) == len(rows) and all(r.train_tokens == total for r in got)
    by = {r.doc_id: r for r in got}
    for r in rows:
        w = (r.text or "").encode().lower().split() + ["END"]
        assert math.isclose(by[r.doc_id].base_score, sum(math.log10((train[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
        assert by[r.doc_id].n_known == sum(train[x] > 0 for x in w) and by[r.doc_id].score < 0
    assert lm.corpus_scores(empty, path).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_language_model_scores_match_a_plain_forward_sum(spark, rounds):
    import numpy as np

    path = public_tokenizers.path("piece_bpe_32k.model")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    rows = d.collect()
    train = Counter(w for r in rows if not lm.held_out(r.doc_id) for w in (r.text or "").encode().lower().split())
    ends = sum(not lm.held_out(r.doc_id) for r in rows)
    pieces, prior = lm.vocabulary(path)
    weight = dict(zip(pieces, prior))
    longest = max(map(len, pieces))

    def paths(word, p):
        x = b"\xff" + word
        a, z = [1.0] + [0.0] * len(x), [0.0] * len(x) + [1.0]
        scale = 0.0
        for j in range(1, len(x) + 1):
            a[j] = sum(a[i] * p.get(x[i:j], 0.0) for i in range(max(0, j - longest), j))
        for i in range(len(x) - 1, -1, -1):
            z[i] = sum(p.get(x[i:j], 0.0) * z[j] for j in range(i + 1, min(len(x), i + longest) + 1))
        return x, a, z, scale

    uses = Counter()
    for _ in range(rounds):
        uses = Counter()
        for w, c in train.items():
            x, a, z, _ = paths(w, weight)
            for i in range(len(x)):
                for j in range(i + 1, min(len(x), i + longest) + 1):
                    if q := weight.get(x[i:j], 0.0):
                        uses[x[i:j]] += c * a[i] * q * z[j] / a[-1]
        whole = sum(uses.values()) + lm.PRIOR_MASS
        weight = {p: (uses[p] + lm.PRIOR_MASS * prior[i]) / whole for i, p in enumerate(pieces)}
    mass = lm.PRIOR_MASS + sum(uses.values())
    share, end = mass / (mass + ends + 1), (ends + 1) / (mass + ends + 1)
    final = {p: v * share for p, v in weight.items()}
    got = {r.doc_id: r.score for r in lm.corpus_scores(d, path, rounds=rounds).collect()}
    for r in rows[:25]:
        words = (r.text or "").encode().lower().split()
        if max(map(len, words), default=0) < 60:
            assert math.isclose(got[r.doc_id], math.log10(end) + sum(np.log10(paths(w, final)[1][-1]) for w in words), rel_tol=1e-6)


def test_whole_words_are_arcs_of_the_lattice(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = {r.doc_id: r for r in lm.corpus_scores(d, path, rounds=1).collect()}
    mixed = {r.doc_id: r for r in lm.corpus_scores(d, path, rounds=1, whole_words=True).collect()}
    train = Counter(w for r in d.collect() if not lm.held_out(r.doc_id) for w in (r.text or "").encode().lower().split() + ["END"])
    total, theta = sum(train.values()), len(train) + 1
    word = spark.createDataFrame([(r.doc_id, r.text) for r in d.limit(20).collect()], "doc_id bigint, text string")
    alone = {}
    names, prior = lm.vocabulary(path)
    assert {bytes([b]) for b in range(256)} <= set(names)  # so no score is infinite
    counts = lm.count_words(d, "doc_id", "text")
    logs, end = lm.piece_weights(counts, names, prior, train["END"], 1)
    lattice = lm.Lattice(names)
    for r in word.collect():
        words = (r.text or "").encode().lower().split()
        q = dict(zip(words, lattice.score(words, logs) / math.log(10))) | {"END": end}
        alone[r.doc_id] = sum(math.log10((train[w] + theta * 10 ** q[w]) / (total + theta)) if train[w] else q[w] + math.log10(theta / (total + theta)) for w in words + ["END"])
    assert all(math.isclose(mixed[i].score, s, rel_tol=1e-9) for i, s in alone.items())
    held = [i for i, r in mixed.items() if r.held_out]
    sums = [sum(x[i].score for i in held) for x in (pieces, mixed)]
    assert sums[0] < sums[1] and all(math.isfinite(r.score) for r in mixed.values())
    few = lm.corpus_scores(docs.where("doc_id is not null"), path, rounds=1, whole_words=True).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in few) and lm.corpus_scores(empty, path, whole_words=True).count() == 0
    none = lm.corpus_scores(spark.createDataFrame([(i, "a b") for i in range(60) if lm.held_out(i)], "doc_id bigint, text string"), path, rounds=1, whole_words=True).collect()
    assert none and all(math.isfinite(r.score) for r in none)


def test_registered_scores_learn_from_the_training_rows(spark):
    got = queries.QUERIES["op5_lm"](spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "count(*) n", "count(score) m").first()
    assert got.n == got.m and got.s > 1.25 * got.b  # the vocabulary's own scores give 2.09 times the base's


def test_lattice_sums_all_segmentations():
    import numpy as np

    pieces = [b"\xffa", b"b", b"a", b"ab", b"\xff", b"\xffab"]
    p = {x: 0.1 + 0.05 * i for i, x in enumerate(pieces)}
    lattice = lm.Lattice(pieces)
    logs = np.log([p[x] for x in pieces])
    want = p[b"\xffab"] + p[b"\xffa"] * p[b"b"] + p[b"\xff"] * (p[b"ab"] + p[b"a"] * p[b"b"])
    assert math.isclose(lattice.score([b"ab"], logs)[0], math.log(want))
    uses = lattice.expected([b"ab"], np.array([2.0]), logs)
    assert math.isclose(uses[0] + uses[4] + uses[5], 2.0)


def test_archives(spark):
    rows = [(1, "http://a/\nb", "same"), (9, None, "same"), (3, "http://c", None), (4, "x", ""), (5, "y", "ü" * 3000), (None, "z", "same"), (5, "y", "ü" * 3000)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("package", F.lit(1))
    got = warczip.archive_roundtrip(d).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert (by[9].record_type, by[1].record_type, by[1].refers_to, by[3].refers_to, by[4].record_type, by[None].refers_to) == ("response", "revisit", 9, 4, "response", 9)
    assert by[5].payload_bytes == 6000 and by[1].payload_digest == warczip.digest(b"same")
    big = warczip.write_package([("archive/data.warc", b"abc"), ("indexes/index.cdx", b"")], zip64=True)
    assert warczip.read_directory(lambda o, n: big[o : o + n], len(big))["archive/data.warc"][3] == 3
    assert warczip.archive_roundtrip(d.limit(0)).count() == 0
    records = [warczip.write_record(i, "http://a/", b"p%d" % i, warczip.digest(b"p%d" % i), None, False) for i in range(4)]
    at = len(records[0])
    index = lambda name, a, b: f"{name} 0 {len(a)}\n{name} {len(a)} {len(b)}\n".encode()
    whole = warczip.write_package([("archive/a.warc", records[0] + records[1]), ("notes.txt", b"x"), ("archive/b.warc", records[2] + records[3]), ("indexes/a.cdx", index("archive/a.warc", *records[:2])), ("indexes/b.cdx", index("archive/b.warc", *records[2:]))], zip64=True)
    reads = []
    found = list(warczip.read_package(lambda o, n: reads.append(n) or whole[o : o + n], len(whole)))
    assert [r["page_id"] for *_, r in found] == [0, 1, 2, 3] and all(whole[o : o + n] in records for o, n, _ in found) and reads.count(at) >= 1
    damaged = whole.replace(b"archive/a.warc 0 ", b"archive/a.warc 9 ")
    with pytest.raises(ValueError):
        list(warczip.read_package(lambda o, n: damaged[o : o + n], len(damaged)))


def test_bpe_agrees_with_the_library(docs, empty):
    raw = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tables(raw).ranks, special_tokens={})
    got = bpe.bpe_encode(docs, raw, public_tokenizers.PATTERN).collect()
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert {r.doc_id: bytes(r.decoded) for r in got if r.doc_id == 11} == {11: TEXTS[11].encode()}
    assert bpe.bpe_encode(empty, raw, public_tokenizers.PATTERN).count() == 0


def test_mix_comes_near_its_targets(spark, docs, empty):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(1, 60), None if i % 11 == 0 else f"s{i % 5}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.pareto_mix(d).collect()
    assert len(got) == 3000 and sorted(got) == sorted(mixing.pareto_mix(d.repartition(7)).collect())
    source = {i: s for i, _, s in rows}
    taken, target, whole = Counter(), {}, Counter()
    for x in got:
        assert x.size == len(rows[x.doc_id][1].split()) and x.taken <= 2 * x.size
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
        whole[source[x.doc_id]] += x.size
    names = sorted((s for s in whole if s), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(whole.values()) - sum(want.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * whole[s]}
        if not over:
            break
        want |= {s: 2.0 * whole[s] for s in over}
        open_ -= over
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= 3
    assert mixing.pareto_mix(empty).count() == 0 and mixing.pareto_mix(docs).count() == docs.count()


def test_mix_includes_documents_by_their_odds(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice((5, 20, 80)), f"s{i % 2}") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in (1, 2, 3):
        got = mixing.pareto_mix(d, seed=seed, weights=(3.0, 1.0)).where("inclusion is not null").groupBy(F.col("target"), "size").agg(F.count("*").alias("n"), F.first("inclusion").alias("p"), F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("share")).collect()
        assert len(got) >= 3 and len({round(x.p, 6) for x in got}) == len(got)
        for x in got:
            assert abs(x.share - x.p) < 4 * (x.p * (1 - x.p) / x.n) ** 0.5 + 0.01


@pytest.mark.parametrize("group", [96, 2])
def test_repeats_match_brute_force(spark, docs, empty, group, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared, line = word(700), word(90)
    told = " ".join(word(4) for _ in range(51))
    texts = list(TEXTS) + [f"one more {told}", f"{told}\n\tand so on", f"not {told[:-2]}"] + [word(r.randrange(300)) + shared[r.randrange(200) : 700 - r.randrange(200)] + word(300) for _ in range(12)] + [line * 12 + word(50), word(500) + "q" + shared]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    got = {x.doc_id: x for x in suffixdedup.remove_repeats(d, passages=True).collect()}
    held = {}
    for i, x in enumerate(raw):
        w = x.split()
        for k in range(len(w) - 50):
            held.setdefault(tuple(w[k : k + 51]), set()).add(i)
    for i, x in enumerate(raw):
        w = x.split()
        assert got[i].n_passages == sum(len(held[tuple(w[k : k + 51])]) > 1 for k in range(len(w) - 50))
    for i, x in enumerate(raw):
        gone = suffixdedup.merged([(s, s + 400) for s in range(len(x) - 399) if seen[x[s : s + 400]] > 1])
        ends = [0, *(v for g in gone for v in g), len(x)]
        kept = b"".join(x[a:b] for a, b in zip(ends[::2], ends[1::2]))
        assert (bytes(got[i].kept), got[i].n_spans) == (kept, len(gone))
    assert suffixdedup.remove_repeats(docs).count() == docs.count() and suffixdedup.remove_repeats(empty).count() == 0


def test_deep_shallow_orders_and_measures():
    r = random.Random(4)
    for _ in range(50):
        base = bytes(r.choice(b"ab") for _ in range(150))
        s = [base[: r.randrange(150)] + bytes(r.choice(b"ab") for _ in range(5)) for _ in range(20)] + [base, base, b""]
        order, lcp = suffixdedup.deep_shallow(s, 16)
        assert [s[i] for i in order] == sorted(s)
        assert lcp[1:] == [suffixdedup._common(s[a], s[b]) for a, b in zip(order, order[1:])]


def test_secrets_of_any_length_go_whole(spark):
    r = random.Random(9)
    secret = "".join(r.choice("ABCDEFGHabcdefgh0123456789-_.") for _ in range(10_000))
    mail = "a" * 300 + "[at]" + "b" * 200 + "[dot]com"
    rows = [(0, f"before token = {secret} after"), (1, f"api_key: '{secret[:480]}'"), (2, f"write to {mail} or {mail}")] + [(i, f"token = {secret[i : i + 24]} and mail x{i}@example.com or y{i}[at]example[dot]com") for i in range(3, 40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = {x.doc_id: x.text for x in pii.redact(d).collect()}
    assert done[0] == "before <secret> after" and secret[:6] not in done[1] and secret[470:480] not in done[1] and "aaaa" not in done[2] and "bbbb" not in done[2]
    spans = {x.id: x.added for x in pii.find_pii(d).collect()}
    assert [(s.start, s.end) for s in spans[0]] == [(7, 7 + len("token = ") + 10_000)]


def test_top_k_is_exact(spark):
    r = random.Random(6)
    rows = [(i, [r.choice((0.0, r.uniform(-1, 1))) for _ in range(8)]) for i in range(200)] + [(200, None), (220, [float("nan")] * 8), (240, [1.0, None]), (None, [1.0] * 8), (260, []), (261, []), (280, [1.0] * 8), (281, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v = topk.quantised(d)
    q = {i: [math.floor(64 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    got = sorted(tuple(x) for x in topk.exact_top_k(v.where("id % 20 = 0"), v).collect())
    want = []
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.exact_top_k(v.where("id < 0"), v).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e8, 0.0]), (1, [1.0, 1.0]), (2, [-3e6, 5.0]), (3, [1.0, 1.0]), (20, [-2.0, 7.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    q = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    want = sorted((i, n + 1, j, -s) for i in (0, 20) for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)))
    assert sorted(tuple(x) for x in topk.exact_top_k(v.where("id % 20 = 0"), v).collect()) == want
    large = topk.quantised(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id bigint, embedding array<double>"))
    with pytest.raises(Exception, match="passes 64 bits"):
        topk.exact_top_k(large.where("id = 0"), large).collect()
