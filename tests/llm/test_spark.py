"""The distributed operators on small fixtures: nulls, empties, repeats, clashing columns, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import chunking, languages, linking, mixing, names, neardup, sentences, spam, tokenize


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokenize(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (2, None, "y"), (3, "", "z"), (1, "hello", "x")], "doc_id long, text string, ids string")
    out = {r.doc_id: r.ids for r in tokenize.encode_documents(df).collect()}
    assert out[2] == out[3] == [] and len(out[1]) >= 1
    assert tokenize.encode_documents(df.limit(0)).count() == 0
    assert rows(tokenize.count_tokens(df, ["doc_id"]))[-1] == (3, 0)


@pytest.mark.parametrize(
    "text, want",
    [
        ("We met Dr. Smith at 3.15 p.m. on Monday. He left.", ["We met Dr. Smith at 3.15 p.m. on Monday.", "He left."]),
        ('One wrote: "It rose. Why did it?" next to the bridge. Then rain.', ['One wrote: "It rose. Why did it?" next to the bridge.', "Then rain."]),
        ("他说“下雨！为什么？”的时候到了。后来呢？", ["他说“下雨！为什么？”的时候到了。", "后来呢？"]),
        ("It is in the U.S. The rest e.g. this, is not. See www.a.example/b.html now", ["It is in the U.S.", "The rest e.g. this, is not.", "See www.a.example/b.html now"]),
        ("One.Two follows.  ", ["One.", "Two follows."]),
        ("", []), ("  ", []), (None, []), ("no mark", ["no mark"]), (" odd.", [" odd."]),
    ],
)
def test_sentences(spark, text, want):
    df = spark.createDataFrame([(1, text, "c")], "k long, t string, spans string")
    assert sentences.with_sentences(df.select("k", "t"), "t").first().sentences == want
    out = sorted(sentences.split_sentences(df.union(df), "k", "t").collect(), key=lambda r: r.sent_no)
    assert [text[r.start_pos - 1 : r.end_pos] for r in out] == want


def test_near_duplicates(spark):
    base = "the quiet river rose in may and nobody had expected so much water near the old bridge of foobaria this year"
    other = "an entirely different sentence about tariffs, ledgers and the price of salt in the northern provinces of the realm"
    data = [("t", 1, base), ("t", 2, base.replace("quiet", "silent")), ("t", 3, other), ("t", 4, None), ("t", 5, ""), ("u", 1, base), ("t", 6, "  " + base.upper() + " "), ("t", 1, base), ("t", 7, "ab"), ("t", 8, "ab")]
    df = spark.createDataFrame(data, "tbl string, id long, text string").withColumn("keys", F.lit("clash"))
    assert rows(neardup.near_duplicates(df)) == [("t", 1, 2), ("t", 1, 6), ("t", 2, 6), ("t", 7, 8)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4, 2000])
def test_full_blocks_use_the_tree(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    base = " ".join(f"word{i} of the long phrase of the trade number {i * 7}" for i in range(12))
    df = spark.createDataFrame([("t", i, base + f" end{i}") for i in range(14)], "tbl string, id long, text string")
    assert neardup.near_duplicates(df).count() == 14 * 13 // 2


def test_names(spark):
    df = spark.createDataFrame([("Smithsonberg, C.; Foo Barlington",), ("Chuck Smithsonberg et al.",), (None,), ("",), ("Charles Smithsonbreg; foo barlington",)], "authors string")
    got = rows(names.variant_pairs(names.link_variants([(df, "authors")])))
    assert ("Chuck Smithsonberg", "Smithsonberg, C.") in got and ("Foo Barlington", "foo barlington") in got
    assert ("Charles Smithsonbreg", "Chuck Smithsonberg") in got
    assert names.link_variants([(df.limit(0), "authors")]).count() == 0


def test_matching(spark):
    items = spark.createDataFrame([(1, "Doe, J.", "2001", "How quiet rivres shape loud valleys in Foobaria", None), (2, None, None, None, None), (3, "Doe", "2001", "How quiet rivers shape loud valleys in Foobaria: part two", None), (1, "Doe, J.", "2001", "How quiet rivres shape loud valleys in Foobaria", None)], "item_id long, cited_author string, cited_year string, ref_title string, matched_pdf string")
    refs = spark.createDataFrame([(7, "Doe, J. (2001). How quiet rivers shape loud valleys in Foobaria. Ann. Quiet, 4(2), 1-9.", "Doe, J.", "2001"), (8, None, None, None), (9, "Roe, K. (1950). Something else entirely about salt. Ann. Quiet, 4(2), 1-9.", "Roe, K.", "1950")], "ref_id long, reference string, authors string, pub_year string")
    got = linking.match_works(items, refs).collect()
    assert [(r.item_id, r.ref_id) for r in got] == [(1, 7)] and 0.5 < got[0].confidence <= 1
    assert linking.match_works(items.limit(0), refs).count() == 0


def test_no_step_of_the_matching_is_broadcast(spark, monkeypatch):
    plans = {}
    real = linking.materialize

    def kept(df, label="step"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(linking, "materialize", kept)
    items = spark.createDataFrame([(1, "Doe, J.", "2001", "How quiet rivers shape loud valleys", None), (2, "Doe, J.", "2001", None, "doe01a_valleys.pdf")], "item_id long, cited_author string, cited_year string, ref_title string, matched_pdf string")
    refs = spark.createDataFrame([(7, "Doe, J. (2001). How quiet rivers shape loud valleys. Ann. Quiet, 4(2), 1-9.", "Doe, J.", "2001")], "ref_id long, reference string, authors string, pub_year string")
    assert rows(linking.match_works(items, refs).select("item_id", "ref_id")) == [(1, 7), (2, 7)]
    assert {"near-names", "last-words", "titles", "scored"} <= {k for k, p in plans.items() if "SortMergeJoin" in p}
    assert not [k for k, p in plans.items() if "Broadcast" in p]


def test_shortened_titles_meet_by_near_names_and_the_text(spark):
    short = "How quiet rivers shape"
    items = spark.createDataFrame([(1, "Foobaringtn, J.", "2001", short, None), (2, "Smithsonberg, C.", "1997", "The late trade of", None)], "item_id long, cited_author string, cited_year string, ref_title string, matched_pdf string")
    refs = spark.createDataFrame([(7, "Foobarington, J. (2001). How quiet rivers shape the loud valleys and the old harbours of northern Foobaria before the reform of tariffs. Ann. Quiet, 4(2), 1-9.", "Foobarington, J.", "2001"), (8, "Smithsonberg, C. (1997). The late trade of salt and timber between inland councils, coastal guilds and the wandering merchants of Bazland. 1997.", None, None)], "ref_id long, reference string, authors string, pub_year string")
    assert rows(linking.match_works(items, refs).select("item_id", "ref_id")) == [(1, 7), (2, 8)]


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + i % 7), "a" if i % 3 else "b") for i in range(300)] + [(900, None, "a"), (901, "", "b"), (902, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.0, None)], "source string, target_share double, max_repeats int")
    mix = mixing.mix(docs, targets)
    share = {r.source: r for r in mixing.reached(mix, targets).collect()}
    assert abs(share["a"].reached_share - 0.5) < 0.02 and share["b"].most_copies <= 3 and share["c"].tokens == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_chunks_pages_languages(spark):
    nodes = spark.createDataFrame([(1, "word. " * 200 + "\f" + "next. " * 20, 4, "x"), (2, "short", 1, "x"), (3, None, None, "x")], "node_no long, text string, page int, cut string")
    got = rows(chunking.oversized_nodes(chunking.split_oversized(nodes)))
    assert got == [(1, "natural", 5)]
    docs = spark.createDataFrame([(1, "buy essay, " * 60), (2, None), (3, "")], "doc_id long, text string")
    assert [r.doc_id for r in spam.page_shares(docs).where("flagged").collect()] == [1]
    en = [f"the {a} {b} and the {c} was closed for the whole winter" for a in ("old", "quiet") for b in ("river rose", "road sank", "wind fell", "rain stopped") for c in ("bridge", "harbour", "school")]
    fr = [f"la {b} et le {c} était fermé pendant tout {a}" for a in ("l'hiver", "le mois") for b in ("rivière monte", "route baisse", "pluie cesse", "neige tombe") for c in ("pont", "port", "lycée")]
    sents = spark.createDataFrame([(i, en[i % 23] if i % 2 else fr[i % 23]) for i in range(40)], "sentence_id long, sentence string")
    results = spark.createDataFrame([(i, i, "en" if i % 2 else "fr") for i in range(38)] + [(38, 38, "en"), (39, 39, None)], "result_id long, sentence_id long, language_label string")
    labels = spark.createDataFrame([("en", "en"), ("fr", "fr")], "label string, lang string")
    assert rows(languages.language_findings(languages.polished_languages(results, sents, labels))) == [(38, 0, "fr"), (39, 0, "en")]


def test_the_model_of_pages_comes_from_all_of_them(spark):
    one = [(i, "The river rose in May, and nobody had expected it.\n" * 8) for i in range(900)]
    other = [(900 + i, "The river rose in May, and nobody had expected it.\nhttps://a.example/b\nbig, old\n" * (2 + i % 3)) for i in range(9)]
    docs = spark.createDataFrame(one + other + [(None, None), (1, " ")], "doc_id long, text string")
    got = spam.fit(spam.page_units(docs.repartition(5)))
    want = spam.baum_welch([spam.symbols(t)[0] for _, t in one + other])
    assert all(np.allclose(a, b) for a, b in zip(got, want))
    # each of the rare pages counts, whatever the hashes of the keys
    without = spam.fit(spam.page_units(docs.where("doc_id is null or doc_id <> 900")))
    assert not np.allclose(np.array(without.emit), np.array(got.emit), rtol=1e-9, atol=0)
    assert spam.fit(spam.page_units(docs.limit(0))) == spam.DEFAULT


def _variants(seed, sizes, share):
    """Groups of texts of 60 words with a share of the words replaced, as (id, text)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    out = []
    for size in sizes:
        base = [word() for _ in range(60)]
        out += [" ".join(word() if rng.random() < share else w for w in base) for _ in range(size)]
    return list(enumerate(out))


def _true_pairs(data, least=0.7):
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for _, t in data]
    return {(data[i][0], data[j][0]) for i in range(len(data)) for j in range(i + 1, len(data)) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9}


def _found_pairs(spark, data):
    df = spark.createDataFrame([("t", i, t) for i, t in data], "tbl string, id long, text string")
    return {(r.id_a, r.id_b) for r in neardup.near_duplicates(df).collect()}


def test_large_groups_keep_their_pairs(spark):
    data = _variants(3, [6] * 5 + [12] * 5 + [30] * 5, 0.06)
    want, got = _true_pairs(data), _found_pairs(spark, data)
    assert len(want) > 800 and got <= want and len(got) >= 0.99 * len(want)


def test_even_edits_and_short_texts(spark):
    data = _variants(4, [1] * 60, 0)
    data += [(1000 + i, "".join("#" if k % 33 == 16 else c for k, c in enumerate(t))) for i, t in data]
    data += [(2000, "a quiet river rose in may"), (2001, "a quiet river rose in maj"), (2002, "安静的河在五月涨水了"), (2003, "安静的河在五月涨水")]
    want, got = _true_pairs(data), _found_pairs(spark, data)
    assert {(2000, 2001), (2002, 2003)} <= want and len(want) > 40
    assert got <= want and len(got) >= 0.98 * len(want) and {(2000, 2001), (2002, 2003)} <= got


def test_blocks_beyond_the_limit_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRED", 3)
    monkeypatch.setattr(neardup, "CHUNK", 5)
    data = _variants(5, [4, 12, 30], 0.06)
    want, got = _true_pairs(data), _found_pairs(spark, data)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_full_blocks_are_spread_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRED", 3)
    data = _variants(6, [40, 2, 2], 0.03)
    rows_ = neardup._block_rows(spark.createDataFrame([("t", i, t) for i, t in data], "tbl string, id long, text string").repartition(2)).collect()
    assert any(r.sketch is not None and len(r.sketch) == 1 for r in rows_) and any(r.sketch == neardup._TELL for r in rows_)
    want, got = _true_pairs(data), _found_pairs(spark, data)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_keys_of_blocks_are_shuffled_in_packs(spark, monkeypatch):
    data = _variants(7, [3] * 60, 0.05)
    df = spark.createDataFrame([("t", i, t) for i, t in data], "tbl string, id long, text string")
    rows_ = neardup._block_rows(df.coalesce(1)).collect()
    assert len(rows_) <= 128  # one for each bucket, of keys and of sketches; not one for each of 56 keys of 180 texts
    assert sum(len(r["hs"]) for r in rows_ if r["keys"]) == 8 * neardup.BANDS * len(data)
    assert sum(len(r["keys"] or b"") for r in rows_) == 4 * neardup.BANDS * len(data)  # the rest of a key is its bucket
    monkeypatch.setattr(neardup, "PACK", 40)
    monkeypatch.setattr(neardup, "FILL", 300)
    want, got = _true_pairs(data), _found_pairs(spark, data)
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)
    pairs, full, sketch = neardup.candidates(df.union(df).repartition(3), len(data))  # copies in other tasks
    assert sketch.count() == len({t for _, t in data}) and full.count() == 0
    assert pairs.where("a >= b").count() == 0 and pairs.count() >= len(want)
    monkeypatch.setattr(neardup, "PAIRED", 2)  # the same keys of full blocks from all buckets and packs
    got = _found_pairs(spark, data)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_large_classes_are_joined_by_their_first_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ALL_PAIRS", 2)
    base = "the quiet river rose in may and nobody had expected so much water near the old bridge of foobaria this year"
    texts = [base] * 4 + [base.replace("quiet", "silent")] * 3
    got = _found_pairs(spark, list(enumerate(texts)))
    assert got == {(0, 1), (0, 2), (0, 3), (4, 5), (4, 6)} | {(i, 4) for i in range(4)} | {(0, j) for j in (4, 5, 6)}


def test_the_judged_pairs_of_near_duplicates(spark):
    word = [f"{a}{b}ing" for a in ("riv", "sto", "lam", "hol", "qua") for b in ("er", "ask", "imp", "orn", "ull", "ent")]
    long = " ".join(word)[:240]
    pairs = [("a quiet river rose in may near a brid.", "a quiet river rose in mai near a brid."), ("安静的河在五月涨水了", "安静的河在五月涨水了呢"), (long, "".join("#" if k % 30 == 15 else c for k, c in enumerate(long)))]
    han = "".join(chr(0x4E00 + (i * 37) % 4000) for i in range(250))
    pairs.append((long + han, han + long))
    data = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    want, got = _true_pairs(data), _found_pairs(spark, data)
    assert {(0, 1), (2, 3), (6, 7)} <= want and got == want


@pytest.mark.parametrize(
    "text, n",
    [
        ("“A one. B two. C three. D four. E five. F six. G seven. H eight.” she said to the board.", 1),
        ("(One. Two. Three. Four. Five.) is long. It ended.", 2),
        ("„Der erste Satz. " + "Noch einer. " * 80 + "Ende.“ sagte sie leise.", 1),
        ('The 5" pipe broke. He wrote: "It rose. Why did it?" next to the bridge. Then rain.', 3),
        ("यह पहला वाक्य है। यह दूसरा है।", 2), ("هل هذا سؤال؟ نعم۔ انتهى", 3), ("Սա առաջինն է։ Սա երկրորդն է։", 2),
    ],
)
def test_long_quotations_and_other_scripts(spark, text, n):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    assert len(sentences.with_sentences(df, "t").first().sentences) == n


def test_mixing_meets_every_share(spark):
    rng = random.Random(2)
    docs = [(i, "word " * rng.randint(5, 60), "abcd"[i % 4] if i % 4 < 3 else "abd"[i % 3]) for i in range(900)] + [(1000 + i, "w " * 40, "e") for i in range(6)]
    targets = [("a", 0.5, 1), ("b", 0.2, 2), ("d", 0.2, 3), ("e", 0.05, 4), ("none", 0.05, 2)]
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.reached(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), t), t).collect()}
    assert all(abs(got[s].reached_share - w / 0.95) < 0.01 and got[s].most_copies <= m for s, w, m in targets[:4]) and got["none"].tokens == 0


def _linked(spark, *authors):
    df = spark.createDataFrame([(a,) for a in authors], "authors string")
    return {r.name: r.entity for r in names.link_variants([(df, "authors")]).collect()}


def test_misspelt_families_of_many_spellings(spark):
    e = _linked(spark, "Smithsonberg, C.; Chuck Smithsonberg; Charles Smithsonberg", "Charles Smithsonbreg; C. Smithsonbreg; Smithsonbreg, Charles", "Quentin Foobarington; Foobarington, Q.; Foobarington", "Zoe Longarm; Longarm, Z.; Longarm, Amy; Longarm, Bea; Longarm")
    assert len({e[n] for n in e if "Smithsonb" in n}) == 1 and len({e[n] for n in e if "Foobarington" in n}) == 1
    assert e["Zoe Longarm"] == e["Longarm, Z."] and len({e[n] for n in e if "Longarm" in n}) == 4  # the bare name is not guessed


def test_chinese_names_by_their_readings(spark):
    e = _linked(spark, "王伟; Wang, Wei; Wei Wang; Wang Wei", "高宇; Gao, Mingyu", "高屿; 高嶼", "Gao, Yu", "欧阳晓明; Ouyang, Xiaoming")
    assert e["王伟"] == e["Wang, Wei"] and e["高屿"] == e["高嶼"] and e["欧阳晓明"] == e["Ouyang, Xiaoming"]
    assert len({e["高宇"], e["高屿"], e["Gao, Yu"], e["Gao, Mingyu"]}) == 4  # a romanised name that fits two is not guessed


def test_readings_that_are_not_to_be_had_are_an_error(spark, monkeypatch):
    def none(name):
        raise AttributeError("no JVM")

    monkeypatch.setattr(names, "_transliterated", none)
    with pytest.raises(RuntimeError, match="Chinese characters"):
        names.readings()
    with pytest.raises(Exception, match="need the readings"):
        _linked(spark, "王伟; Wang, Wei")
    e = _linked(spark, "Lee, Christopher; Lee, C.")  # names in letters need none
    assert e["Lee, Christopher"] == e["Lee, C."]


def test_readings_in_a_thread_without_a_session(spark):
    from concurrent.futures import ThreadPoolExecutor

    names._transliterated.cache_clear()
    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(names.readings).result().given["伟"] == "wei"


def test_the_family_name_is_the_part_that_the_collection_uses(spark):
    e = _linked(spark, "Lee, Christopher; Lee, C.; Lee, Dana", "Christopher Lee; Lee Dana")
    assert e["Christopher Lee"] == e["Lee, Christopher"] == e["Lee, C."] and e["Lee Dana"] == e["Lee, Dana"]
