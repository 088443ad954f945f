import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexivane.llm import (
    common,
    decontamination,
    language_id,
    ngram_join,
    quality_crf,
    quality_rules,
    sentencepieces,
    token_counts,
    token_store,
    unit_ids,
    url_filters,
    warc,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", " \n ", "a", "Hello  world\n\n", "l'été «déjà» vu 漢字 😀", "x  y ", "<|endoftext|> a<|endoftext|>", "▁▁a▁", "don't 're'll\t!?", "z" * 3000, "wörd " * 3000]


def table(spark, texts, **extra):
    """Documents with odd values, a null id, a repeated row and columns whose names clash with results."""
    rows = [(i, t, "src0", "en", 1.5, "x") for i, t in enumerate(texts)] + [(None, "no id here", None, None, None, None)] + [(0, texts[0], "src0", "en", 1.5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score double, host string")


def empty(spark):
    return table(spark, ["a"]).where("false")


def test_token_counts_match_the_library_at_every_prefix():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BPE), token_counts.PrefixCounter(BPE)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    random.seed(1)
    parts = ["'", "'re", "'ll", " ", "  ", "\n", "a", "th", "é", "漢字", "12", "!", "'?!", "<|endoftext|>", "<|endo", "\t", " ", "😀", "the"]
    for text in ["".join(random.choice(parts) for _ in range(random.randint(0, 8))) for _ in range(300)]:
        assert token_counts.table(own.steps(text)).tolist() == [count(text[:i]) for i in range(len(text) + 1)], text


def test_token_counts_frame(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    got = token_counts.count_tokens(table(spark, ODD), BPE).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "no id here" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 1024)
        counts = token_counts.table(zlib.decompress(r["steps"]))
        assert counts[r["fit_chars"]] <= 1024 and (counts[r["fit_chars"] + 1 :] > 1024).all()
    assert token_counts.count_tokens(empty(spark), BPE).count() == 0


def test_token_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    got = token_store.round_trip(table(spark, ODD), BPE, f"file://{tmp_path}/store").orderBy("start").collect()
    order = [None, 0, 0, *range(1, len(ODD))]
    assert [r["doc_id"] for r in got] == order
    start = 0
    for r, i in zip(got, order):
        text = "no id here" if i is None else ODD[i] or ""
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], list(r["ids"]), r["ids_crc32"]) == (start, ids, zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert token_store.round_trip(empty(spark), BPE).count() == 0


def test_token_store_finds_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    manifest = token_store.write_store(table(spark, ["one two three", "four"]), BPE, folder)
    pack = next(tmp_path.glob("store/*.pack"))
    pack.write_bytes(bytes(len(pack.read_bytes())))
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, manifest).collect()


def test_token_store_keeps_equal_chunks_once(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(4000))
    token_store.write_store(spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string").repartition(4), BPE, f"file://{tmp_path}/s")
    one = tmp_path / "one"
    token_store.write_store(spark.createDataFrame([(0, text)], "doc_id long, text string"), BPE, f"file://{one}")
    size = lambda p: sum(x.stat().st_size for x in p.glob("*.pack"))
    assert size(tmp_path / "s") == size(one) > 0


def test_sentencepieces(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepieces.encode(table(spark, ODD), PIECES)
    for r in got.collect():
        text = "no id here" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        assert list(r["ids"]) == lib.encode(text) and r["same"]
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(got, PIECES).collect()}
    assert back[6] == ODD[6] and back[0] == ""
    assert sentencepieces.encode(empty(spark), PIECES).count() == 0
    random.seed(3)
    own = sentencepieces.Vocabulary(PIECES)
    texts = ["".join(random.choice([" ", "  ", "\n", "the", "ing", "é", "漢", "▁", ");", "\r", "x"]) for _ in range(12)) for _ in range(300)]
    assert [x.tolist() for x in own.encode(texts)] == lib.encode(texts)


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines, dup = set(), (text or "").split("\n"), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_rules(spark):
    texts = [*ODD, "a b c a b c a b c", "l\nl\n\n \nl", "# $ | <x>", " ".join(f"w{i}" for i in range(60)), "w x y z " * 40]
    got = quality_rules.quality_rules(table(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute_rules("no id here" if r["doc_id"] is None else texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 2 * want[4] > want[0])
    assert quality_rules.quality_rules(empty(spark)).count() == 0 and quality_rules.clean(empty(spark)).count() == 0


def test_bad_hosts_are_rejected_by_either_join(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 else "bad", "fine") for i in range(200)] + [(1000 + i, "bad" if i % 10 else good, "poor") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {i for i, t, s in rows if t == good and s == "fine"}
    for limit in (0, 100):
        assert {r[0] for r in quality_rules.quality_rules(docs, broadcast_rows=limit).where("kept").select("doc_id").collect()} == want
        assert {r[0] for r in quality_rules.clean(docs, limit).select("doc_id").collect()} == want


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets, parent = [grams(t) for _, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g]).items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                a, b = find(rows[k][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(k)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def test_ngram_join_against_brute_force(spark):
    random.seed(5)
    rows = []
    for j, (size, edits, low) in enumerate([(150, 5, 0), (150, 6, 2), (40, 3, 0), (12, 2, 0), (300, 9, 2)]):
        for k in range(70):
            words = [f"b{j}_{i}" for i in range(size)]
            for _ in range(random.randint(low, edits)):
                i, z = random.randrange(len(words)), random.random()
                words[i : i + (z < 0.8)] = [f"w{random.randrange(40)}"] * (z > 0.2)
            rows.append((1000 * j + k, " ".join(words)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "a b"), (9006, "x " * 9000), (9007, "y x " * 3000)]
    random.shuffle(rows)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(rows)


def test_ngram_join_odd_tables(spark):
    got = ngram_join.jaccard_join(table(spark, ["same words here now", "other", "Same words here NOW", "no id here"]))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in got.collect()) == [(False, 0, 0), (False, 0, 0), (False, 1, 1), (False, 2, 0), (False, 3, 3), (True, 0, 3)]
    assert ngram_join.jaccard_join(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    assert {r["x"]: r["root"] for r in ngram_join.components(edges).collect()} == {i: 0 for i in range(301)} | {1000: 1000, 2000: 1000}


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2\n3", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 3_000_000), (6, "u", "\r\n\r\nWARC/1.1"), (6, "u", "\r\n\r\nWARC/1.1"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string")
    for limit in (0, 1000):
        folder = f"file://{tmp_path}/{limit}"
        got = warc.read_archives(spark, warc.write_archives(pages, folder, broadcast_rows=limit), folder).collect()
        assert len(got) == len(rows)
        kinds = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got}
        assert kinds == {1: (9, "revisit", 2), 2: (9, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (3_000_000, "response", None), 6: (12, "response", None), None: (5, "response", None)}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_finds_damage():
    import gzip
    import io

    plain = warc.record(1, "u", b"payload", __import__("hashlib").sha1(b"payload").hexdigest(), None)
    (head, block), = warc.Reader(io.BytesIO(gzip.compress(plain)))
    assert warc.checked(head, block)[5] == b"payload"
    (head, block), = warc.Reader(io.BytesIO(gzip.compress(plain.replace(b"payload", b"paylaod"))))
    with pytest.raises(ValueError, match="digest"):
        warc.checked(head, block)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.Reader(io.BytesIO(gzip.compress(plain)[:-9])))


def test_decontamination(spark):
    item = "If Alice buys 12 apples for 3 dollars each and then sells 7 apples to Robert how many does Alice keep"
    bench = spark.createDataFrame([(1, item), (2, "short one here"), (3, None), (4, "plain words that make a passage of quite some length to be found again")], "item_id long, text string")
    other = item.replace("Alice", "Maria").replace("12", "40").replace("7", "9").replace("Robert", "Peter")
    mixed = item.replace("Alice", "Maria", 1).replace("12", "40").replace("many does Alice", "many does Eva")
    texts = [f"Before it. {item}. After it.", f"So: {other}!", f"So: {mixed}", "short one here", "and short one here too", "PLAIN words, that make a passage of quite\nsome length to be found again.", "nothing at all of the kind " * 50, None]
    got = {r["doc_id"]: list(r["items"]) for r in decontamination.decontaminate(table(spark, texts), bench).where("doc_id IS NOT NULL").collect()}
    assert got == {0: [1], 1: [1], 2: [], 3: [2], 4: [], 5: [4], 6: [], 7: []}
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    assert decontamination.clean(table(spark, texts), bench.where("false")).count() == len(texts) + 2
    assert {r[0] for r in decontamination.clean(table(spark, texts), bench).where("doc_id IS NOT NULL").select("doc_id").collect()} == {2, 4, 6, 7}


def test_language_id(spark):
    own = {"en": "the and of that with this there which", "de": "der und die nicht ein schön für über", "fr": "les une des être pour avec français où"}
    random.seed(1)
    rows = [(i, " ".join(random.choices(own[lang].split(), k=40)), lang) for i, lang in enumerate(random.choices(list(own), k=120))]
    docs = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 ...", "en"), (502, "", None)], "doc_id long, text string, lang string")
    profiles = language_id.learn(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, profiles).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    assert {got[i]["lang_pred"] for i in (500, 501, 502)} == {"und"}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert language_id.identify(docs, {}).where("lang_pred != 'und'").count() == 0


def test_quality_classifier(spark):
    random.seed(2)
    good = lambda: "\n".join(" ".join(f"word{random.randrange(300)}" for _ in range(20)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(f"X{random.randrange(300)}!!" for _ in range(20)) for _ in range(4))
    rows = [(i, good() if i % 3 else bad()) for i in range(150)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(900, None)], "doc_id long, quality int")
    crf = quality_crf.learn(docs, labels)
    got = {r["doc_id"]: r for r in quality_crf.classify(docs, crf).collect()}
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i, _ in rows) and len(got) == 152
    assert quality_crf.keep_good(docs, crf).where("doc_id < 900").count() == 100
    none = quality_crf.learn(docs, labels.where("false"))
    assert {r["score"] for r in quality_crf.classify(docs, none).collect()} == {0.5}


def test_crf_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    from itertools import product

    total, single = 0.0, np.zeros((4, 2))
    for y in product((0, 1), repeat=4):
        w = np.exp(sum(emit[k, y[k]] for k in range(4)) + sum(trans[y[k], y[k + 1]] for k in range(3)))
        total += w
        for k in range(4):
            single[k, y[k]] += w
    # log odds of a line speak for good; emit is for either label
    forward, backward = quality_crf.messages(np.append(emit[:, 1] - emit[:, 0], emit[0, 1] - emit[0, 0]), trans, quality_crf.Chains(np.array([4, 1])))
    got = 1 / (1 + np.exp(-(forward + backward)))
    assert np.allclose(got[:4], single[:, 1] / total) and np.isclose(got[4], np.exp(emit[0, 1]) / np.exp(emit[0]).sum())


def test_crf_score_and_gradient_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    for counts in ([4, 1, 3], [5], [2, 2]):
        chains = quality_crf.Chains(np.array(counts))
        good, trans, weight = rng.normal(size=sum(counts)), rng.normal(size=(2, 2)), rng.random(sum(counts))
        weight /= np.repeat(np.add.reduceat(weight, chains.first), counts)

        def brute(good, trans):
            out = []
            for first, n in zip(chains.first, counts):
                chances = {y: np.exp(sum(good[first + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1))) for y in product((0, 1), repeat=n)}
                out.append(sum(c * sum(weight[first + k] * y[k] for k in range(n)) for y, c in chances.items()) / sum(chances.values()))
            return np.array(out)

        score, by_line, by_trans = quality_crf.score_gradient(good, weight, trans, chains)
        assert np.allclose(score, brute(good, trans))
        for k, d in enumerate(np.eye(len(good)) * 1e-5):
            assert np.isclose((brute(good + d, trans) - brute(good - d, trans)).sum() / 2e-5, by_line[k], atol=1e-6)
        for j, k in product((0, 1), repeat=2):
            d = np.zeros((2, 2))
            d[j, k] = 1e-5
            assert np.allclose((brute(good, trans + d) - brute(good, trans - d)) / 2e-5, by_trans[:, j, k], atol=1e-6)
        forward, backward = quality_crf.messages(good, trans, chains)
        if len(counts) == 1:
            assert np.allclose(quality_crf._messages_alone(good.tolist(), trans), forward + backward)


def quality_rows(seed, n):
    random.seed(seed)
    good = lambda: "\n".join(" ".join(f"word{random.randrange(300)}" for _ in range(20)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(f"X{random.randrange(300)}!!" for _ in range(20)) for _ in range(4))
    return [(i, good() if i % 3 else bad()) for i in range(n)], good, bad


def test_lines_of_a_mixed_document_are_labelled_apart(spark):
    rows, good, bad = quality_rows(2, 150)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    crf = quality_crf.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    chance, _, counts = crf.marginals([good() + "\n" + bad(), bad()])
    assert counts.tolist() == [8, 4] and (chance[:3] > 0.8).all() and (chance[5:] < 0.2).all()


def test_score_equals_that_of_whole_features_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    crf = quality_crf.Crf(rng.normal(size=3 * quality_crf.OWN + 1), rng.normal(size=(2, 2)))
    texts = ["", "one", "x\n\nx\ny |!\n" * 30, "A b.\n" * 9, "z" * 5000, "é" * 700 + "\n1 2 3"]
    want = []
    for t in texts:
        x, n = quality_crf.line_features(t)
        chains = quality_crf.Chains(np.array([len(x)]))
        p = 1 / (1 + np.exp(-sum(quality_crf.messages(x.astype(float) @ crf.weights, crf.trans, chains))))
        want.append(float((p * np.maximum(n, 1)).sum() / np.maximum(n, 1).sum()))
    assert np.allclose(crf.score(texts), want, atol=1e-4)
    for name, value in (("BLOCK_BYTES", 50), ("BLOCK_LINES", 3), ("ALONE", 20)):
        monkeypatch.setattr(quality_crf, name, value)
        assert np.allclose(crf.score(texts), want, atol=1e-4)


def test_quality_classifier_defined_cases(spark):
    rows, good, bad = quality_rows(4, 90)
    docs = spark.createDataFrame([(i, t, "x", 2.0) for i, t in rows] + [(None, bad(), "x", 2.0), (1, bad(), "x", 2.0), (2, rows[2][1], "x", 2.0), (500, (good() + "\n") * 2000, None, None)], "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (4, 0)], "doc_id long, quality int")
    got = [tuple(r) for r in quality_crf.classify(docs, quality_crf.learn(docs, labels)).select("doc_id", "predicted").collect()]
    assert len(got) == 94 and (None, 0) in got and (500, 1) in got and got.count((2, 1)) == 2 and {(1, 0), (1, 1)} <= set(got)
    again = quality_crf.learn(docs.orderBy(F.desc("text")), labels)
    assert np.allclose(again.weights, quality_crf.learn(docs, labels).weights, atol=1e-3)
    assert quality_crf.classify(docs.where("false"), quality_crf.learn(docs.where("false"), labels)).count() == 0


URLS = ["http://A.Example.com/en/1", "https://www.example.com/en/x?y", "http://example.net/es/a", "http://net/fr/", "http://x.org/a/b#c", "no scheme", None, "http://a.com", "http://a.com?x=/", "://h/p"]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "url_key long, bad int")
    for limit in (0, 1000):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filter(pages, labels, broadcast_rows=limit).collect()}
        assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
        assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
        assert got[2][2:] == ("net/es/", "block") and got[3] == ("net", "/fr/", "net/fr/", "block")
        assert got[4] == ("x.org", "/a/b", None, "allow") and got[5] == got[6] == ("", "", None, "allow")
        assert got[7][:3] == ("a.com", "", None) and got[8][:3] == ("a.com", "", None) and got[9][:2] == ("h", "/p")
    assert url_filters.url_filter(pages.where("false"), labels).count() == 0


def test_bad_templates_are_rejected(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)], "url_key long, bad int")
    got = url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels)
    assert {(r["template"], r["verdict"]) for r in got.collect()} == {("/spam/{n}", "block"), ("/news/{n}", "allow")}


def near_groups(seed, n, similarity):
    """Rows with near copies on both sides of the similarity, and their n-gram sets, null and short texts included."""
    random.seed(seed)
    rows = []
    for j, (size, edits) in enumerate([(301, 9), (120, 4), (40, 2), (14, 1)]):
        for k in range(40):
            words = [f"b{j}_{i}" for i in range(size)]
            for _ in range(random.randint(0, edits)):
                words[random.randrange(size)] = f"w{random.randrange(30)}"
            rows.append((1000 * j + k, " ".join(words)))
    rows += [(9000, None), (9001, " "), (9002, "one two"), (9003, "ONE two"), (9004, "x " * 500)]
    random.shuffle(rows)
    words = [(t or "").lower().split() for _, t in rows]
    sets = {i: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for (i, _), w in zip(rows, words)}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}
    return rows, sets, links


def smallest_linked(ids, links):
    root = {i: i for i in ids}
    while True:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new


@pytest.mark.parametrize(("n", "similarity"), [(5, 0.8), (3, 0.9), (2, 0.65)])
def test_ngram_join_at_other_similarities(spark, n, similarity):
    rows, sets, links = near_groups(11, n, similarity)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), n=n, similarity=similarity)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == smallest_linked(sets, links)


def test_pipeline_drops_copies_at_five_words_and_0_8(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(301)]
    near = [f"x{i}" if i in range(20, 300, 50) else w for i, w in enumerate(words)]  # 0.8165 of five words, 0.886 of three
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "another text of its own")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


@pytest.mark.parametrize(("n", "similarity", "block"), [(3, 0.9, 256), (5, 0.8, 7)])
def test_ngram_join_loses_no_link(spark, monkeypatch, n, similarity, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows, sets, links = near_groups(12, n, similarity)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.jaccard_join(docs, n=n, similarity=similarity).collect()}
    count, root = Counter(i for ab in links for i in ab), smallest_linked(sets, links)
    assert got == {i: (root[i], count[i]) for i in sets}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    size = Counter(rep.values())
    want = {(a, b, size[a], size[b]) for a, b in links if rep[a] == a and rep[b] == b}
    pairs = ngram_join.links(docs, n=n, similarity=similarity).collect()
    assert len(pairs) == len(want) and {tuple(r) for r in pairs} == want


def test_decontamination_finds_items_in_any_context(spark):
    items = ["What is the capital of the country", "What is the longest river that runs through the whole of the old country", "什么是法国的首都", "フランスの首都はどこですか、そしてその人口は何人ですか"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"see exercise {t} and more" for t in items[:2]] + [f"Heading\n{t}" for t in items[:2]] + [f"前文{items[2]}后文", f"前{items[3]}。後"]
    texts += ["see exercise Alice is the capital of the country and more", "法国的首都是什么"]
    got = {r["doc_id"]: list(r["items"]) for r in decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {0: [0], 1: [1], 2: [0], 3: [1], 4: [2], 5: [3], 6: [], 7: []}


def test_decontamination_finds_verbatim_items_of_mere_slots(spark):
    items = ["What comes next: 1, 1, 2, 3, 5, 8, 13, 21, 34, 55", "Who Wrote The Lord Of The Rings And The Hobbit"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Before it. {items[0]}. After it.", f"quiz night {items[1]}? Answer", "What comes next: 2, 2, 4, 6, 10, 16, 26, 42, 68, 110", "Ann Saw All Men Bob And Eve Had Met In Rome Once"]
    got = {r["doc_id"]: list(r["items"]) for r in decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {0: [0], 1: [1], 2: [], 3: []}


def test_bad_branches_are_found_at_any_depth(spark):
    deep = "http://h.org/2020a/05b/en/x/y/z"
    rows = [(i, f"{deep}/{'casino' if i % 2 else 'news'}/{i}") for i in range(300)] + [(1000, "http://h.org/"), (1001, f"{deep}/news/a/b/c/d")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 3)], "url_key long, bad int")
    got = url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "block" if i < 300 and i % 2 else "allow" for i, _ in rows}
    assert {r["template"] for r in got if r["page_id"] < 300} == {"/{a}/{a}/en/x/y/z/casino/{n}", "/{a}/{a}/en/x/y/z/news/*"}


def test_near_duplicates_against_brute_force_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    rows, _, _ = near_groups(13, 5, 0.8)
    rows = [(None if k % 9 == 0 else i - i % 3, t) for k, (i, t) in enumerate(rows)] + [(1000, "the same text twice here")] * 2 + [(None, "the same text twice here"), (None, None)]
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = smallest_linked(range(len(rows)), links)
    groups = defaultdict(list)
    for k, r in root.items():
        groups[r].append(rows[k])
    by = lambda i: (i is None, i or 0)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert len(got) == len(groups)
    left = list(got)
    for group in groups.values():
        least = min((i for i, _ in group), key=by)
        mine = [r for r in left if r in group and r[0] == least]
        assert mine, group
        left.remove(mine[0])
    assert not left


def test_rare_languages_keep_whole_profiles(spark):
    random.seed(4)
    rows = [(i, " ".join(random.choices("the and of that with this there".split(), k=6)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(random.choices("ein schön für über nicht".split(), k=6)), "de") for i in range(12)] + [(None, "où être français", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, every = language_id.learn(docs, sample=30), language_id.learn(docs)
    assert set(few) == {"de", "en", "fr"}
    assert few["de"].tolist() == every["de"].tolist() and few["fr"].tolist() == every["fr"].tolist()


def test_token_store_starts_of_ids_that_cross_partitions(spark, monkeypatch):
    monkeypatch.setattr(token_store, "RECIPE_BYTES", 2000)
    rows = [(5, f"text number {k} of five") for k in range(400)] + [(6, "the only six")] + [(None, "") for _ in range(50)]
    got = token_store.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BPE).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 50 + [5] * 400 + [6]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]


def test_unit_encoder_matches_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BPE), token_store.CachedEncoder(BPE)
    assert own.simple is not None
    random.seed(2)
    parts = ["'", "'re", " ", "  ", "\n", "\n\n", "a", "th", "é", "漢字", "12", "!", "<|endoftext|>", "<|endo", "\t", "\xa0", "the", "ß", "Éa", ".", "\x00", "\x1c", "’s", "ª", "×", "1é", "é.", "Ñ%"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]


def test_ngram_join_keeps_rows_of_one_id_apart(spark):
    words = [f"w{i}" for i in range(80)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(80))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (None, a + " less"), (None, "alone here now"), (9, None), (9, "")]
    for order in (rows, rows[::-1]):
        got = ngram_join.jaccard_join(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_links"]) for r in got) == [(-1, -1, 0), (-1, 1, 2), (1, 1, 2), (2, 1, 1), (2, 1, 2), (3, 1, 1), (9, 9, 0), (9, 9, 0)]


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_signatures_and_sizes_of_linked_sets(num, den):
    rng = np.random.default_rng(7)
    for size in (30, 400, 3000, 30_000):
        k = size * (den - num) // num
        base = rng.integers(0, 1 << 63, size + k, dtype=np.uint64) * np.uint64(2)
        one, two = np.unique(base[:size]), np.unique(base)  # as far apart as links allow
        (a, tags), (b, other_tags) = ngram_join.signatures(one, num, den), ngram_join.signatures(two, num, den)
        shared = np.intersect1d(a, b)
        band = tags[np.isin(a, shared)] >> 16
        assert len(shared) and len(set(band.tolist())) == 1 and set(band.tolist()) <= set((other_tags >> 16).tolist())
        for t in (tags, other_tags):
            assert len(shared) > (t[(t >> 16) == band[0]] & 0xFFFF).max()
        frame = lambda *sets: pd.DataFrame({"x": range(len(sets)), "n": map(len, sets), "sizes": map(ngram_join.profile, sets), "star": range(len(sets)), "keys": [[1]] * len(sets), "block": 0, "i": 0, "j": 0})
        other = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        assert ngram_join._alike(frame(one, two), num, den) == [(1, 0)]
        if size > 30:
            assert ngram_join._alike(frame(one, other, two), num, den) == [(2, 0)]


def test_decontamination_of_mid_sentence_and_recased_copies(spark):
    items = ["Who wrote the famous novel about whales and the sea", "When did Anna Karl and her brother Peter leave the town of Berlin for good", "a b c d"]
    bench = spark.createDataFrame([*enumerate(items), (None, "an item whose own id is not known to anyone at all here")], "item_id long, text string")
    texts = [f"he asked the class {items[0]} and left", f"so {items[1].lower()} then", f"SO {items[1].upper()} THEN", f"X {items[0].upper()}!", "whales and the sea wrote the famous novel about who", "x a B c, d y", "say an item whose own id is not known to anyone at all here too"]
    got = {r["doc_id"]: (r["contaminated"], list(r["items"])) for r in decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {0: (True, [0]), 1: (True, [1]), 2: (True, [1]), 3: (True, [0]), 4: (False, []), 5: (True, [2]), 6: (True, [])}


def brute_items(texts, items):
    """Items of which a text has 13 words in a row, or all, whatever their case and outer punctuation."""
    plain = lambda t: [x for w in t.split() if (x := w.strip(decontamination._EDGES).lower())]
    out = {}
    for k, t in enumerate(texts):
        words, found = plain(t), []
        for i, item in enumerate(items):
            own = plain(item)
            size = min(13, len(own))
            parts = {tuple(own[a : a + size]) for a in range(len(own) - size + 1)}
            if any(tuple(words[a : a + size]) in parts for a in range(len(words) - size + 1)):
                found.append(i)
        out[k] = found
    return out


def planted(seed, n_items, n_texts):
    random.seed(seed)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(600)]
    phrase = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [phrase(random.randint(5, 40)).capitalize() + "?" for _ in range(n_items)]
    texts = []
    for _ in range(n_texts):
        text, item = phrase(random.randint(30, 200)), random.choice(items)
        words = item.split()
        cut = random.choice([item, item.lower(), item.upper(), f'"{item}"', " ".join(words[: len(words) // 2]), item.replace(" ", "\n"), ""])
        texts.append(f"{text} {cut} {phrase(20)}" if random.random() < 0.8 else text)
    return items, texts


@pytest.mark.parametrize("limit", [50_000, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontamination, "TOGETHER", 3000)
    items, texts = planted(6, 60, 300)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(0, texts[0], True), (None, texts[1], True)], "doc_id long, text string, contaminated boolean")
    got = decontamination.decontaminate(docs, bench).collect()
    want = brute_items(texts, items)
    assert len(got) == len(texts) + 2 and sum(map(bool, want.values())) > 100
    assert {r["doc_id"]: list(r["items"]) for r in got if r["doc_id"] is not None} == want
    left = decontamination.clean(docs, bench).collect()
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == sorted([i for i, f in want.items() if not f] + [0] * (not want[0]))


def test_decontamination_of_other_numbers_and_names(spark):
    random.seed(8)
    names, fill = ["Alice", "Robert", "Maria", "Peter", "Eva", "Tom"], ["apples", "pears", "books", "coins"]
    make = lambda a, b, x, y, z: f"If {a} buys {x} boxes of {z} for {y} dollars each and then gives half of them to {b} how many does {a} keep in the end"
    item = make("Alice", "Robert", 12, 3, "apples")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    same = [make(*random.sample(names, 2), random.randint(2, 99), random.randint(2, 99), "apples") for _ in range(20)]
    other = ["".join(f"{random.choice(fill)} cost {random.randint(2, 99)} dollars and {random.choice(names)} buys them. " for _ in range(8)) for _ in range(20)]
    texts = [f"Some words first. {t}. And more after it." for t in same] + other
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {k: k < 20 for k in range(40)}


def brute_grams(text):
    """Counts of a text's n-grams."""
    import itertools

    parts = ["".join(g) if letter else " " for letter, g in itertools.groupby(f"{text} ", key=str.isalpha)]
    plain = "".join(x.lower() if len(x.lower()) == 1 else x for x in "".join(parts)).lstrip(" ")
    return Counter(g for n in (1, 2, 3) for k in range(len(plain) - n + 1) if (g := plain[k : k + n]) != " ")


def brute_rank(counts):
    """Ranks; of equal counts the last letter counts most, a blank less than any letter, and none least."""
    number = lambda g: tuple(1 if c == " " else ord(c) for c in reversed(g.ljust(3, "\0")))
    return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], number(g)))[: language_id.PROFILE])}


def test_language_id_against_dictionaries(spark):
    random.seed(9)
    own = {"en": "the and of that with this there which", "de": "der und die nicht ein schön für über ß", "fr": "les une des être pour avec français où", "xx": "\U00010400\U00010401\U00010402 \U00020000\U00020001 \U00010428\U00010429"}
    rows = [(i, " ".join(random.choices(own[lang].split(), k=random.randint(1, 25))) + random.choice(["", ".", " 12!", "\n"]), lang) for i, lang in enumerate(random.choices(list(own), k=160))]
    rows += [(900, "İstanbul ǅ \ud800 x".replace("\ud800", ""), None), (901, "\U00010401\U00010402", None), (902, None, "en"), (903, "12 34", None), (904, "the " * 300_000, None), (1, rows[1][1], rows[1][2]), (None, "und die", "de")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    learned = defaultdict(Counter)
    for i, text, lang in rows:
        if lang and text is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            learned[lang] += brute_grams(text)
    profiles = {lang: brute_rank(c) for lang, c in sorted(learned.items())}
    want = []
    for i, text, _ in rows:
        mine = brute_rank(brute_grams(text or ""))
        if not mine:
            want.append((i, "und", 0.0))
            continue
        far = {lang: sum(abs(r - p[g]) if g in p else language_id.PROFILE for g, r in mine.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        want.append((i, best, round(1 - far[best] / (len(mine) * language_id.PROFILE), 9)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, language_id.learn(docs)).collect()]
    by = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=by) == sorted(want, key=by)
    assert {i: lang for i, lang, _ in got}[901] == "xx"
    assert language_id.identify(docs.where("false"), language_id.learn(docs.where("false"))).count() == 0


def brute_stages(spark, rows, labels, bench):
    """The pipeline's rows by plain Python: the classifier's and decontamination's models are the operators', everything else is written here."""
    crf = quality_crf.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels)
    kept = [r for r, s in zip(rows, crf.score([r[1] or "" for r in rows])) if s >= 0.5]
    passed = lambda t: (w := brute_rules(t))[0] >= 50 and 2 * w[4] <= w[0]
    hosts = defaultdict(list)
    for r in kept:
        hosts[r[3]].append(not passed(r[1]))
    share = sum(sum(v) for v in hosts.values()) / max(1, sum(map(len, hosts.values())))
    assert share < 0.5  # no host is near rejection in these rows
    kept = [r for r in kept if passed(r[1])]
    words = [r[1].lower().split() for r in kept]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    links = [(a, b) for b in range(len(kept)) for a in range(b) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root = smallest_linked(range(len(kept)), links)
    least = {}
    for k, r in root.items():
        if r not in least or kept[k][0] < kept[least[r]][0]:
            least[r] = k
    kept = [kept[k] for k in sorted(least.values())]
    items = [t for _, t in bench]
    return [r for r, found in zip(kept, brute_items([r[1] for r in kept], items).values()) if not found]


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    random.seed(21)
    vocabulary = ["".join(random.choices("abcdefghijklm", k=random.randint(3, 8))) for _ in range(900)]
    line = lambda n: " ".join(random.choices(vocabulary, k=n)).capitalize() + "."
    good = lambda: "\n".join(line(random.randint(15, 30)) for _ in range(4))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in random.choices(vocabulary, k=20)) for _ in range(4))
    bench = [(i, line(20)) for i in range(6)]
    texts = [good() for _ in range(150)] + [bad() for _ in range(60)]
    texts += [" ".join(w if k % 40 else "changed" for k, w in enumerate(texts[i].split(" "))) for i in range(0, 40, 2)]  # near copies
    texts += [texts[5]] * 4 + [f"{good()}\n{t.lower() if i % 2 else t}\n{good()}" for i, t in bench] + ["too short", "", None, line(60) * 3]
    random.shuffle(texts)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    quality = [(i, int(not (t or "").isupper())) for i, t, *_ in rows if t and len(t.split()) > 50]
    labels = spark.createDataFrame(quality, "doc_id long, quality int")
    for name, df in (("documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), ("labels", labels), ("benchmark", spark.createDataFrame(bench, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    want = brute_stages(spark, rows, labels, bench)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert 100 < len(want) < 200
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {r[0]: lib.encode(r[1]) for r in want} and len(got) == len(want)


def test_pipeline_stages_keep_the_columns_and_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids array<int>, component_id long"
    rows = [(None, None, None, None, None, 1.0, [1], 2), (1, "", "en", "s", 0, 1.0, [1], 2), (1, "", "en", "s", 0, 1.0, [1], 2), (2, " ".join(f"word{i}" for i in range(20_000)), "en", "s", 9, 1.0, [1], 2)]
    for table, schema_ in (("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema_).write.parquet(f"{tmp_path}/{table}.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
            docs = docs.cache()
            docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() <= 1


def test_ngram_join_keeps_links_of_lists_of_two(spark):
    """A text that links with two others, with each of them by lists that hold nothing else."""
    _, parts = ngram_join.parts_of(162, 242, 9, 10)
    spot = lambda w: int(ngram_join.shingles(w, 1)[0]) * parts >> 64
    words, spare = [f"w{i}" for i in range(242)], [f"z{i}" for i in range(4000)]

    def changed(touched):
        """12 words go and 12 come, each in a fragment of its own of those."""
        gone = {spot(w): w for w in words if spot(w) in touched}
        new = {spot(w): w for w in spare if spot(w) in touched}
        where = sorted(gone)[:12]
        assert len(where) == 12
        return [w for w in words if w not in {gone[k] for k in where}] + [new[k] for k in sorted(touched - set(where))[:12]]

    one, two = changed(set(range(0, 24))), changed(set(range(parts - 24, parts)))
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(words))]
    assert len(set(words) & set(one)) == len(set(words) & set(two)) == 230  # 230 of 254 link, one and two have 218 to 224 of 260 and more
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ngram_join.jaccard_join(docs, n=1, similarity=0.9).collect()
    assert sorted(tuple(r) for r in got) == [(1, 242, 1, 1), (2, 242, 1, 1), (3, 242, 1, 2)]
    assert sorted(tuple(r) for r in ngram_join.links(docs, n=1, similarity=0.9).collect()) == [(1, 3, 1, 1), (2, 3, 1, 1)]


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_unrelated_long_texts_share_no_lists(spark, num, den):
    """Empty fragments are no signatures, at whatever place in its band a set's size lies."""
    rng, seen = np.random.default_rng(3), []
    for size in (600, 947, 1421, 1500, 4000, 9000):
        lower = ngram_join.bands(num, den)
        band = int(np.searchsorted(lower, size, side="right")) - 1
        for n in (lower[band], size, lower[band + 1] - 1):
            keys, tags = ngram_join.signatures(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)), num, den)
            assert (tags & 0xFFFF).min() > 0
            seen.append(keys)
    assert np.unique(np.concatenate(seen), return_counts=True)[1].max() == 1


def test_written_leaves_no_shuffle_files(spark):
    env, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {f for d in env.blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(key, None)
    df = spark.range(1000).repartition(3, "id")
    common.written(df, "t")
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key, None) == setting
    df.collect()
    assert files() - before  # others keep theirs


def rare_words(n, words):
    rng = random.Random(5)
    return [" ".join("".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(3, 11))) for _ in range(words)) for _ in range(n)]


def test_encoding_of_new_units_takes_little_memory():
    own, texts = sentencepieces.Vocabulary(PIECES), rare_words(200, 300)
    own.encode(texts[:2])
    tracemalloc.start()
    try:
        own.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 55e6


@pytest.mark.parametrize("size", [1, 7, 500])
def test_encoding_with_a_cache_that_drops_units_of_the_batch(size):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.Vocabulary(PIECES)
    own.kept = common.Recent(size)
    texts = [t for t in ODD if t] + rare_words(30, 20) + ["漢▁ x" * 50, "z" * 3000 + " b"]
    for _ in range(3):
        random.Random(6).shuffle(texts)
        assert [x.tolist() for x in own.encode(texts)] == lib.encode(texts)


@pytest.mark.parametrize("most", [1, 40, 5000])
def test_units_keep_their_ids_in_a_table_that_drops_units(most):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.Vocabulary(PIECES)
    own.known = unit_ids.UnitIds("int32", most)
    rng, parts = random.Random(7), [" ", "  ", "\n", "\n\n", "the", "ing", "é", "漢", "▁", "\0", "\0a", " \0", " \n", "\r", "x" * 70, "𝒳", "\U0010fffd"]
    texts = [t for t in ODD if t] + rare_words(30, 20) + ["".join(rng.choice(parts) for _ in range(12)) for _ in range(300)]
    for _ in range(3):
        rng.shuffle(texts)
        for at in range(0, len(texts), 60):
            assert [x.tolist() for x in own.encode(texts[at : at + 60])] == lib.encode(texts[at : at + 60])
        own.known.shrink(most // 3)
        assert len(own.known) == len(own.known.sizes) <= most // 3 and max(map(len, own.known.numbers), default=0) <= 64
    assert own.encode([]) == [] and own.encode(["", ""])[1].tolist() == []


def test_units_that_come_again_are_encoded_once_also_in_the_next_task():
    own, calls = sentencepieces.Vocabulary(PIECES), []
    own._encode_units = lambda units, put=own._encode_units: calls.append(units) or put(units)
    for texts in (["again and again\nand again", "once again"], ["once again\nand again"]):
        own.encode(texts)
    assert list(map(sorted, calls)) == [["\n", " again", " and", " once", "and"]]
    own.known.shrink(sentencepieces.STAYING)
    own.encode(["again once\nand"])
    assert len(calls) == 1


@pytest.mark.parametrize("most", [1, 40, 5000])
def test_token_store_encoder_with_a_table_that_drops_units(most):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BPE), token_store.CachedEncoder(BPE)
    own.known = unit_ids.UnitIds(own.kind, most)
    rng, parts = random.Random(9), [" ", "\n", " the", " ing", "é", "漢", "\0", " \0", "<|endoftext|>", " <|endo", "'ll", "\t", "\xa0", "x" * 70]
    texts = [t or "" for t in ODD] + rare_words(30, 20) + ["".join(rng.choice(parts) for _ in range(8)) for _ in range(300)]
    texts += [" ".join("aé"[k % 2] * n for k, n in enumerate(rng.choices(range(1, 20), k=40))) + "\nab\n" + "b" * k for k in range(20)]
    for _ in range(3):
        rng.shuffle(texts)
        for at in range(0, len(texts), 90):
            part = texts[at : at + 90]
            assert [x.tolist() for x in own.encode(part)] == [e.ids for e in lib.encode_batch_fast(part, add_special_tokens=False)]


def test_token_store_splits_plain_texts_without_a_string_a_word():
    own, texts = token_store.CachedEncoder(BPE), rare_words(40, 500)
    want = [x.tolist() for x in own.encode(texts)]
    own._encode_units = None  # nothing is new
    tracemalloc.start()
    try:
        got = own.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [x.tolist() for x in got] == want
    assert len(own.known.numbers) == 0 and peak < 6e6


def test_table_of_units_against_a_dictionary():
    rng, table, known = np.random.default_rng(10), unit_ids._Table(2), {}
    for _ in range(30):
        low, high = rng.integers(1, 60, 300, dtype=np.uint64), rng.integers(0, 60, 300, dtype=np.uint64)
        keys = list(zip(low.tolist(), high.tolist()))
        assert table.find(low, high).tolist() == [known.get(k, -1) for k in keys]
        new = [k for k in dict.fromkeys(keys) if k not in known]
        known |= {k: len(known) + n for n, k in enumerate(new)}
        table.put(*np.array(new, dtype=np.uint64).reshape(-1, 2).T, np.array([known[k] for k in new], dtype=np.int32))
        assert table.count == len(known)


def test_held_gives_freed_memory_back():
    def mb():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    common.held("a test's arrays", lambda: [bytes(60_000) + bytes([k % 256]) for k in range(2000)])
    last = bytes(60_000) + b"x"  # above what is freed: the heap can't shrink by itself
    most = mb()
    common.held("another's", dict)
    common._held.clear()
    assert mb() < most - 80 and last


def test_near_copies_get_no_more_than_a_row_a_pivot():
    """Members of one group whose pairs are left, as far apart as links allow: a row each, and none for what earlier lists compare."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    own = [np.unique(np.append(rng.permutation(base)[: 150 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64))) for k in rng.integers(5, 40, 200).tolist()]
    g = {"x": np.arange(200), "p": np.zeros(200, dtype=np.int64), "n": np.array([len(s) for s in own]), "star": np.arange(200), "block": np.arange(200) % 2}
    g |= {"i": np.zeros(200, dtype=np.int64), "j": np.ones(200, dtype=np.int64), "sizes": np.array([ngram_join.profile(s) for s in own], dtype=object), "keys": [[1]] * 200}
    stars = ngram_join._alike(g, 4, 5)
    left = ngram_join._left(g, 4, 5)
    assert len(stars) > 1000 and {x for s in stars for x in s} - {0} == {x for x, _ in left} and len(left) == len(set(left)) < 200
    assert {p for _, p in left} == {0}
    assert ngram_join._left(g | {"earlier": [[k // 100] for k in range(200)]}, 4, 5)
    assert not ngram_join._left(g | {"earlier": [[7, k + 10] for k in range(200)]}, 4, 5)


def test_rules_write_no_copy_of_the_texts(spark, monkeypatch):
    columns, put = set(), quality_rules.written
    monkeypatch.setattr(quality_rules, "written", lambda df, name: columns.update(df.columns) or put(df, name))
    texts = [" ".join(f"w{i}" for i in range(60)), "too short"]
    assert [r["doc_id"] for r in quality_rules.clean(table(spark, texts)).collect()] == [0, 0]
    assert columns == {"host", "n", "failed", "rejected"}
