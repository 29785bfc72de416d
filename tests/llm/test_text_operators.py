"""Operators that scan each text: licences, languages, pieces, scores."""

import hashlib
import re
import string

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gapweave.llm import langid, licences, masked, op1, pieces, quality
from gapweave.llm.tokens import ALNUM, SPACE, Slice, words

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sliced(texts):
    data = [t.encode() for t in texts]
    return Slice(0, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


@pytest.mark.parametrize("inside, pattern", [(ALNUM, WORD), (SPACE, re.compile(r"[^\x20\x09-\x0D]+"))])
def test_words_are_those_of_the_pattern(inside, pattern):
    texts = ["", "a", "abcdefgh", "abcdefghi jklmnopqrstuvwxyz0123456789", "Été, ÜBER-all\n漢字 x_y", "end", "start", "AbC abc", "  ", "a" * 33, "\x85nel nb"]
    w = words(sliced(texts), inside)
    by_hash = {}
    for i, t in enumerate(texts):
        want = pattern.findall(t.translate(LOWER))
        got = w.hash[w.bounds[i]:w.bounds[i + 1]].tolist()
        assert len(got) == len(want)
        for h, v in zip(got, want, strict=True):
            assert by_hash.setdefault(h, v) == v
    assert len(set(by_hash.values())) == len(by_hash)


def brute_licences(text):
    w = WORD.findall((text or "").translate(LOWER))
    found = []
    for label, phrase in licences.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_base(spark, awkward, empty):
    for r, t in [(r, r.text) for r in licences.scan(awkward, ["doc_id", "text"]).collect()]:
        n, k, *_ = brute_licences(t)
        assert (r.n_words, sum(f.whole for f in r.found)) == (n, k)
    got = licences.report(awkward).collect()
    assert len(got) == awkward.count()
    ten = next(r for r in got if r.doc_id == 10)
    assert ten[1:6] == brute_licences(awkward.where("doc_id = 10").first().text)
    assert ten.labels == "cc-by-nc,cc-by-nc-4,mit" and ten.score == 1.0
    assert licences.report(empty).count() == 0


def test_licence_words_keep_the_kelvin_sign(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (2, "MKT License"), (3, "mİt license")], "doc_id long, text string")
    assert {r.doc_id: r.n_base for r in licences.report(docs).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.doc_id: r.n_words for r in licences.report(docs).collect()} == {1: 2, 2: 2, 3: 2}


def test_licence_query_counts_the_phrases_of_its_contract(spark, tmp_path):
    """A bare "mit license" is no base phrase of the query; its label stays, found by the method."""
    texts = ["Under the MIT License", "the MIT license", "x under the mit-license, under the MIT License; Apache License, Version 2", "CC BY NC 4.0 under the mit", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in op1.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got == {
        0: (4, 1, 0, 0, "mit", "mit"), 1: (3, 0, None, None, "", "mit"), 2: (13, 3, 1, 9, "apache-2,mit", "apache-2,mit"),
        3: (8, 1, 0, 0, "cc-by-nc", "cc-by-nc"), 4: (0, 0, None, None, "", ""), 5: (0, 0, None, None, "", "")}


def test_licence_template_with_a_changed_word_needs_its_key_phrase(spark):
    text = "This work was licensed under the GNU General Public License, version 3."
    docs = spark.createDataFrame([(1, text), (2, text.replace("Public", "Private"))], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.report(docs).collect()}
    assert got[1].labels == "gpl-3" and 0.75 <= got[1].score < 1 and got[2].labels == ""


def test_languages(spark, awkward, empty):
    texts = ["the cat sat on the mat and this was it " * 4, "der Hund und die Katze sind nicht müde " * 4] * 40
    model = langid.train(texts, ["en", "de"] * 40)
    clash = awkward.select("doc_id", "text", "score", "key", F.lit(1).alias("letter0"), F.lit(2).alias("_letter"))
    got = langid.predict(clash, model, runs="runs").collect()
    assert len(got) == awkward.count()
    for r in got:
        assert 0 <= r.score <= 1 and (r.key, r.letter0, r["_letter"]) == ("other", 1, 2)
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter)
        runs = r.runs
        assert sum(x["to"] - x["from"] for x in runs) == len((r.text or "").encode())
    assert langid.predict(empty, model).count() == 0
    # Alike wherever a text stands in a batch.
    same = {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    pred = langid.predict(spark.createDataFrame([(1, "this was the mat"), (2, "die Katze und der Hund")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in pred.collect()} == {1: "en", 2: "de"}


def test_language_query_does_not_send_texts_back(spark, awkward):
    out = langid.predictions(awkward)
    made = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line)
    assert "text#" not in re.search(r", \[([^\]]*)\]", made)[1] and out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert out.count() == awkward.count()


def test_language_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    h = langid.HIDDEN
    table, recur = (rng.standard_normal(s).astype(np.float64) * 0.5 for s in ((3 * h, 256), (3 * h, h)))
    x = rng.integers(0, 256, (5, 3))
    weight = rng.standard_normal((5, h, 3))

    def loss(t, u):
        return float((langid._steps(t.astype(np.float32), u.astype(np.float32), x, False)[0] * weight).sum())

    _, cache = langid._steps(table.astype(np.float32), recur.astype(np.float32), x, True)
    d_table, d_recur = langid._backward(table.astype(np.float32), recur.astype(np.float32), x, cache, weight.astype(np.float32))
    for m, d, at in ((table, d_table, (4, x[1, 0])), (table, d_table, (h + 2, x[2, 1])), (table, d_table, (2 * h + 1, x[0, 2])), (recur, d_recur, (3, 1)), (recur, d_recur, (2 * h, 5))):
        up, down = m.copy(), m.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        pair = ((up, recur), (down, recur)) if m is table else ((table, up), (table, down))
        assert abs((loss(*pair[0]) - loss(*pair[1])) / 2e-2 - d[at]) < 2e-2


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs)
    both = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in both) / len(both) > 0.95
    assert langid.predictions(docs.limit(0)).count() == 0


MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def test_pieces_are_the_librarys(spark, awkward, empty, texts):
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    odd = ["  Hello   World\n\tthé ①ﬁ▁x \x00<s>", " ", "  ", "\n\n a", "a" * 2000, "日本語 текст 🙂🙂  .", "x=y isn't e.g. a's,b \"c\" (d)e|f", "▁▁a▁", "áb ", "<0x41></s>"]
    docs = spark.createDataFrame([*enumerate([*odd, *list(texts.values())[:60]])], "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    got = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    for r in got:
        ids = lib.encode(r.text or "")
        assert r.ids == ids and r.decoded == lib.decode(ids)
    for r in pieces.digests(docs.withColumn("doc_id", F.struct("doc_id", "text")), MODEL).collect():
        ids = lib.encode(r.doc_id.text or "")
        want = (len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
    digest = pieces.digests(awkward, MODEL).collect()
    assert len(digest) == awkward.count()
    null = next(r for r in digest if r.doc_id == 3)
    assert null.n_tokens == 0 and null.ids_sha256 == null.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.digests(empty, MODEL).count() == 0


def test_pieces_across_letters_that_are_not_alphabetic(spark):
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rows = ["no signs", "an area of 5 km².", "m²., km².", "²., x². ½. Ⅷ, ①)", "a².b².\n²."]
    docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string").coalesce(1)
    assert {r.text: r.ids for r in pieces.encode(docs, MODEL).collect()} == {t: lib.encode(t) for t in rows}


def test_pieces_cut_wrongly_stop_the_job(spark, monkeypatch):
    """A text that is not among the sampled ones, cut where a piece reaches across."""
    right = pieces.vocabulary

    def wrong(model):
        v = right(model)
        v.apart["²".encode()[-1], ord(".")] = True
        return v

    monkeypatch.setattr(pieces, "vocabulary", wrong)
    docs = spark.createDataFrame([(0, "no signs"), (1, "an area of 5 km².")], "doc_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="encodes a text otherwise"):
        pieces.encode(docs, MODEL).collect()


def test_agenda_tables_join_as_the_heap_does():
    v = pieces.vocabulary(MODEL)
    coder = pieces.Coder(MODEL, v)
    rng = np.random.default_rng(8)
    chunks = sorted({" " * int(rng.integers(0, 3)) + "".join(rng.choice(list("theaioinrsTé1-"), int(rng.integers(1, 30)))) for _ in range(500)})
    coder._learn(chunks)
    for i, c in enumerate(chunks):
        got = coder.flat[coder.at[i]:coder.at[i + 1]].tolist()
        assert got == pieces.merge(v, c.replace(" ", pieces.SPACE))
        assert coder.decimal[i] == "".join(f"{x}," for x in got).encode()


def test_pieces_of_a_frame_with_a_column_of_that_name(spark, awkward):
    out = pieces.encode(awkward, MODEL)
    assert out.columns.count("ids") == 1 and out.where("key = 'other'").count() == awkward.count()


def test_decoding_odd_ids(spark):
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    lists = [[3 + 0xE2, 3 + 0x91], [3 + 0xC3, 15043], [15043, 3 + 0xFF, 3 + 0xE2, 3 + 0x91, 3 + 0xA0], [1, 15043, 2], []]
    docs = spark.createDataFrame([*enumerate(lists)], "doc_id long, ids array<int>")
    for r in pieces.decode(docs, MODEL).collect():
        assert r.decoded == lib.decode(r.ids), r


def brute_score(text, known, w):
    ids = masked.ids_of(words(sliced([text]), ALNUM).hash, known).tolist()
    total = 0.0
    for i, token in enumerate(ids):
        h = w["hidden"].astype(float).copy()
        for k, o in enumerate(masked.OFFSETS):
            h += w["around"][k][ids[i + o] if 0 <= i + o < len(ids) else masked.TOKENS]
        h = h / (1 + abs(h))
        a, b = w["high"] @ h + w["high_bias"], w["low"] @ h + w["low_bias"][token // masked.SIDE]
        total += a[token // masked.SIDE] - np.log(np.exp(a).sum()) + b[token % masked.SIDE] - np.log(np.exp(b).sum())
    return len(ids), total


def test_masked_scores(spark, awkward, empty, small, texts, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = masked.vocabulary(docs)
    counts = {}
    for t in texts.values():
        for h in words(sliced([t or ""]), ALNUM).hash.tolist():
            counts[h] = counts.get(h, 0) + 1
    least = min(counts[h] for h in known.tolist())
    assert sum(n > least for n in counts.values()) <= len(known) == min(masked.KNOWN, len(counts))
    before = masked.beginning()
    model = (known, masked._round(masked.token_table(docs, "text", known), before))
    for r in masked.score(docs, model).limit(20).collect():
        n, total = brute_score(texts[r.doc_id] or "", *model)
        assert r.n_tokens == n and abs(r.log_prob - total) < 1e-3 * max(1, n)
    mean = [masked.score(docs, m).agg({"log_prob": "sum"}).first()[0] for m in ((known, before), model)]
    assert mean[1] > mean[0]
    # What is learned depends on the texts, not on how they lie.
    monkeypatch.setattr(masked, "SHARD", 20000)
    for parts in (1, 8):
        again = masked._round(masked.token_table(docs.repartition(parts, "doc_id"), "text", known), before)
        first = again if parts == 1 else first
        assert all((again[k] == first[k]).all() for k in again)
    odd = masked.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in odd)
    nothing = masked.train(empty)
    assert len(nothing[0]) == 0 and masked.score(empty, nothing).count() == 0


def test_masked_scores_of_words_beyond_the_frequent_ones(spark, awkward, empty, small, texts):
    """Each word of a class by its share in the whole corpus; an invented word has the share of one occurrence."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known, w, table = model = masked.train(docs, rounds=1)
    counts, classes = {}, {}
    for t in texts.values():
        for h in words(sliced([t or ""]), ALNUM).hash.tolist():
            counts[h] = counts.get(h, 0) + 1
    assert {r.word % 2**64: r.n for r in table.collect()} == counts and len(counts) > masked.TOKENS
    frequent = set(known.tolist())
    for h, n in counts.items():
        if h not in frequent:
            classes[h % (masked.TOKENS - masked.KNOWN)] = classes.get(h % (masked.TOKENS - masked.KNOWN), 0) + n

    def brute(text):
        n, total = brute_score(text, known, w)
        for h in words(sliced([text]), ALNUM).hash.tolist():
            if h not in frequent:
                total += np.log(counts.get(h, 1) / (classes.get(h % (masked.TOKENS - masked.KNOWN), 0) + 1))
        return n, total

    got = masked.score(docs, model).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got[:20]:
        n, total = brute(texts[r.doc_id] or "")
        assert r.n_tokens == n and abs(r.log_prob - total) < 1e-3 * max(1, n)
    # A rarer word met often, and an invented one of its class: the network alone cannot tell them apart.
    often = max((h for h in counts if h not in frequent), key=counts.get)
    names = {h: x for t in texts.values() for x in WORD.findall((t or "").translate(LOWER)) for h in words(sliced([x]), ALNUM).hash.tolist()}
    made = next(x for x in (f"zzq{i}" for i in range(10**5)) if (h := int(words(sliced([x]), ALNUM).hash[0])) not in counts and (h - often) % 256 == 0)
    two = {r.doc_id: r.log_prob for r in masked.score(spark.createDataFrame([(0, names[often]), (1, made)], "doc_id long, text string"), model).collect()}
    assert abs(two[0] - two[1] - np.log(counts[often])) < 1e-3
    odd = masked.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in odd)
    assert len({(r.n_tokens, r.log_prob) for r in odd if r.doc_id in (1, 2)}) == 1
    assert masked.score(empty, model).count() == 0


def test_masked_gradients_agree_with_differences():
    rng = np.random.default_rng(2)
    w = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in masked.beginning().items()}
    ids = rng.integers(0, masked.TOKENS, 40)
    around = masked.neighbours(ids, np.array([0, 15, 40]))
    g = masked._gradients(w, around, ids)

    def loss(v):
        return -float(masked._forward(v, around, ids)[0].astype(float).mean())

    for k, at in (("around", (1, around[5, 1], 3)), ("hidden", (2,)), ("high", (ids[0] // 32, 4)), ("high_bias", (5,)), ("low", (ids[3] % 32, 1)), ("low_bias", (ids[7] // 32, ids[7] % 32))):
        up, down = ({n: x.copy() for n, x in w.items()} for _ in range(2))
        up[k][at] += 0.05
        down[k][at] -= 0.05
        assert abs((loss(up) - loss(down)) / 0.1 - g[k][at]) < 2e-3


def brute_measures(text):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    w = space.findall(text or "")
    grams, covered, seen, dup = {}, set(), set(), 0
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    for x in (text or "").split("\n"):
        if space.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures(spark, awkward, empty, small):
    docs = awkward.select("doc_id", "text", "lang", "n_words").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for r in quality.measure(docs, ["text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.row.text)
    got = quality.verdicts(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.verdicts(empty, labels.limit(0)).count() == 0
    assert sorted(quality.keep_good(awkward, labels).columns) == sorted(awkward.columns)


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(k, n) for n in (1, 5, 30, 400, 3000) for k in (0, 1, 2, 4, 13) if k <= n]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        want = sum(comb(r.n, i) * 0.01**i * 0.99**(r.n - i) for i in range(r.k + 1))
        assert r.p == 1.0 if r.k >= r.n * 0.01 else abs(r.p - want) < 1e-9 * max(want, 1e-6) + 1e-12
    big = spark.createDataFrame([(9000, 1_000_000)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).first().p
    assert 0 < big < 1e-20


def test_certified_cutoffs_reject_and_keep(spark):
    """Plain text is good, text full of symbols is bad; a cutoff is certified only with enough good ones."""
    plain, loud = " ".join(f"word{i}" for i in range(20)), " ".join(f"w{i} ###" for i in range(20))
    rows = [(i, plain + f" n{i}", "en") for i in range(3000)] + [(5000 + i, loud + f" n{i}", "en") for i in range(20)] + [(9000 + i, loud + f" m{i}", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(9000 + i, 1) for i in range(20)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.verdicts(docs, labels).collect()}
    assert all(got[i] for i in range(3000)) and not any(got[5000 + i] for i in range(20)) and all(got[9000 + i] for i in range(20))
