"""Row-local cores of the training-data operators against brute force and defined results."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import chunking, languages, linking, mixing, names, neardup, spam, tokenize

DIR = tokenize.TOKENIZER_DIR


@pytest.fixture(scope="module")
def encoder():
    return tokenize.encoder(f"{DIR}/{tokenize.BYTE_BPE_50K}")


def test_tokens_equal_the_public_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, "Hello, world's  end\n\n", "中文字" * 200, "a" * 999, " " * 300 + "x", "<|endoftext|> héllo 😀‍👩 123456", "It's 3.14!! " * 50]
    random.seed(3)
    texts += ["".join(random.choice("ab éÀ中の1 .\n\t😀") for _ in range(random.randint(0, 80))) for _ in range(300)]
    ids, offsets = encoder.encode(texts)
    for i, x in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == (t.encode(x, add_special_tokens=False).ids if x else [])


@given(st.text(alphabet="ab. ,\n中。é\f", max_size=2600))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text(text):
    got = chunking.cut_text(text)
    if not text:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][2] == len(text)
    longest = max(map(len, re.split(r"[\s.!?;:,。！？；：，、]", text)))
    assert any(f for *_, f in got) == (longest > chunking.LIMIT)
    for a, new, b, _ in got:
        assert b - a <= chunking.LIMIT and 0 <= new - a <= chunking.OVERLAP and new < b
    assert all(x[2] == y[1] for x, y in zip(got, got[1:]))


def test_unbroken_stretches():
    assert not any(f for *_, f in chunking.cut_text("x" * 900 + " " + "y" * 900))
    assert any(f for *_, f in chunking.cut_text("x" * 901))


def test_tree_finds_what_brute_force_finds():
    random.seed(1)
    words = "alpha beta gamma delta omega sigma kappa lambda theta zeta".split()
    texts = [" ".join(random.choice(words) for _ in range(random.randint(3, 30))) for _ in range(120)]
    texts += [t.replace("alpha", "alphq", 1) for t in texts[:50]]
    doc, grams = neardup.Batch(texts).sets()
    size = np.bincount(doc, minlength=len(texts))
    i, j = neardup.RTree(neardup.point(doc, grams, len(texts)), size, 4).pairs(0.7)
    got = {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    sim = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    want = {(a, b) for a in range(len(texts)) for b in range(a) if sim(a, b) >= 0.7}
    assert want and want <= got
    exact = neardup.similarities(texts[:60], texts[60:120])
    assert np.allclose(exact, [sim(k, 60 + k) for k in range(60)])


@pytest.mark.parametrize("a, b", [("Smithsonberg, C.", "Chuck Smithsonberg"), ("SMITHSONBERG, Charles", "Charles Q. Smithsonberg"), ("Gao, Xue Ke", "Xueke Gao"), ("The Foobarian Society of Robust Writing", "FSRW (Foobarian)")])
def test_names_of_one(a, b):
    ka, ta, ra = names.parse(a)
    kb, tb, rb = names.parse(b)
    assert (ka, ta) == (kb, tb)
    assert len(names.family_groups([(a, ra), (b, rb)], ka)) == 1


def test_names_of_two():
    _, _, c = names.parse("Smithsonberg, Charles")
    _, _, q = names.parse("Quentin Smithsonberg")
    assert names.align(c, q) is None
    assert len(names.family_groups([("a", c), ("b", q), ("c", [])], "p")) == 3  # a bare name is not guessed
    assert names.edits("kitten", "iktten") == 1 and names.edits("abcdef", "uvwxyz") == 3


def test_titles():
    t = "How quiet rivers shape loud valleys in Foobaria"
    for ref in (f'Doe, J., 2001, "{t}," Journal 1, 2-3.', f"Doe, J. (2001). {t}. Ann. Quiet, 4(2), 1-9.", f"Doe, J.: {t}. In: Ann. Quiet, Vol. 3 (2001), pp. 1-2.", f"Doe, J.. {t}. Ann. Quiet.. 2001;4(2):1-9."):
        assert linking.plain(linking.reference_title(ref, "Doe, J.")) == linking.plain(t)
    a, b = linking.plain(t), linking.plain("How quiet rivres shape loud valleys in Foobaria")
    assert linking.align_titles(a, b)[0] > 0.9
    assert linking.align_titles(a, linking.plain("How quiet forests shape loud valleys in Foobaria"))[0] == 0.0
    assert linking.reference_title(None, None) == "" and linking.file_title(None) == ("", "")
    assert linking.confidence(1.0, 1.0, 0) > linking.confidence(0.8, None, 1)


def test_pages():
    assert spam.shares(None) == spam.shares(" \n") == [0.0] * 4
    stuffed = "cheap essay, cheap essay, essay help, cheap essay help, " * 30
    assert sum(spam.shares(stuffed)[1:3]) > 0.5
    prose = "The river rose in May. Nobody had expected so much water, and the old bridge was closed. Later the council met to decide what to do about it."
    assert spam.shares(prose)[0] == 1.0
    assert sum(spam.shares("\n".join(f"https://a{i}.example/x" for i in range(20)))[1:3]) > 0.5


def test_languages():
    rows = [("en", f"the river {w} and the bridge was closed for the winter") for w in ("rose", "fell", "froze", "flooded")] * 3
    rows += [("fr", f"la rivière {w} et le pont était fermé pendant tout l'hiver") for w in ("monte", "baisse", "gèle", "déborde")] * 3
    model = languages.Classifier(languages._contents(rows))
    assert model.text("the bridge was closed and the river froze")[0] == "en"
    assert model.text("le pont était fermé et la rivière gèle pendant l'hiver")[0] == "fr"
    lang, _, parts = model.text("The river rose and the bridge was closed for the winter. Le pont était fermé pendant tout l'hiver.")
    assert lang == "mixed" and [p[2] for p in parts] == ["en", "fr"]
    assert model.text(None) == (None, 0.0, []) and model.text("12 ...")[0] is None


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(5)
    pi, tokens = rng.uniform(0.1, 0.9, 500), rng.integers(10, 500, 500).astype(float)
    x = np.column_stack([tokens / tokens.mean(), np.ones(500)])
    out = mixing.flight(pi, x, np.arange(500))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert np.allclose(out @ x, pi @ x, atol=1e-6)
    done = mixing.landing(out, tokens)
    assert set(done) <= {0.0, 1.0} and abs(done @ tokens - pi @ tokens) <= tokens.max()


def test_plan():
    got = mixing.plan([("a", 100), ("b", 10)], [("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.0, 1)])
    assert got["b"] == (2.0, 20.0) and got["a"][1] == 90.0 and got["c"] == (0.0, 0.0)


def test_keyword_lists_of_many_words():
    rng = random.Random(1)
    for n in (44, 46, 100, 180):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)] * 20
        rng.shuffle(words)
        assert spam.shares("\n".join(", ".join(words[i : i + 8]) for i in range(0, len(words), 8)))[2] > 0.9
        assert spam.shares(" ".join(words))[2] > 0.9
    assert spam.shares("\n".join(f"cheap{i}.shop\nbuy at best{i}.store/x" for i in range(20)))[1] > 0.9
    prose = "The river rose in May, and nobody had expected so much water. See www.a.example/b for the whole report on the flood. Most towns were warned at noon. A second wave came late, as https://b.example tells us with many pictures. Only three bridges stood."
    assert spam.shares(prose)[0] > 0.9


def test_the_fit_keeps_the_states():
    rows = [[0] * 20] * 50 + [[1] * 10] * 5 + [[2] * 10] * 5 + [[3, 3, 0, 3]] * 5
    model = spam.baum_welch(rows)
    assert [spam.label(r, model)[0] for r in ([0] * 9, [1] * 9, [2] * 9, [3] * 9)] == [0, 1, 2, 3]
    assert np.allclose(np.exp(model.emit).sum(axis=1), 1) and np.allclose(np.exp(model.move).sum(axis=1), 1)
    assert all(np.allclose(a, b) for a, b in zip(spam.baum_welch([]), spam.DEFAULT))


def test_other_languages_of_a_script_are_rejected():
    ru = [f"мы рассматриваем {a} {b} и их влияние на {c}" for a in ("долгие", "малые", "старые") for b in ("сроки", "рынки", "реки") for c in ("поведение людей", "цены хлеба", "местную власть")]
    en = [f"the {a} {b} and the effect on {c}" for a in ("long", "small", "old") for b in ("terms", "markets", "rivers") for c in ("people", "bread", "power")]
    model = languages.Classifier({"ru": "\n".join(ru).encode(), "en": "\n".join(en).encode()})
    assert model.text(ru[0] + ".")[0] == "ru" and model.text("Це речення написано українською мовою, і воно має бути відхилене.")[0] is None
    assert model.text("Ово је реченица на српском језику која треба да буде одбијена.")[0] is None


def test_any_number_of_given_names():
    assert names.align(list("abcdef"), list("abcdef")) == 0 and names.align(list("abcdefg"), list("gfedcba")) is not None
    assert names.align(["anna", "b", "c", "d", "e"], ["anna", "b", "c", "d", "x", "y"]) is None


def test_close_titles_share_a_key():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    missed = total = 0
    for n in (1, 2, 3, 5, 8, 12):
        for _ in range(450):
            a = " ".join(rng.choice(words) for _ in range(n))
            at = rng.choice([i for i, c in enumerate(a) if c != " "])
            b = a[:at] + rng.choice("xyz") + a[at + 1 :]
            va, vb = linking.encode(a), linking.encode(b)
            total += 1
            missed += not set(linking.keys_of(a, va)) & set(linking.keys_of(b, vb))
    assert total == 2700 and missed == 0
    # without luck: every two vectors closer than the number of chunks with a bit
    for _ in range(300):
        v = np.packbits(np.array([rng.random() < 0.1 for _ in range(linking.BITS)], np.uint8))
        w = v.copy()
        chunks = sum(bool(v[i : i + 4].any()) for i in range(0, 64, 4))
        for bit in rng.sample(range(linking.BITS), chunks - 1):
            w[bit // 8] ^= 1 << bit % 8
        assert set(linking.keys_of("x" * 40, v.view(np.int64))) & set(linking.keys_of("x" * 40, w.view(np.int64)))


def test_calibrated_confidence():
    rng = random.Random(5)
    truth, counts = {}, {}
    for _ in range(40000):
        good = rng.random() < 0.8
        k = tuple(rng.choices(range(len(f[0])), f[0 if good else 1])[0] for f in (((0.6, 0.2, 0.1, 0.1), (0.1, 0.1, 0.3, 0.5)), ((0.9, 0.08, 0.02), (0.2, 0.3, 0.5)), ((0.8, 0.1, 0.05, 0.05), (0.1, 0.1, 0.1, 0.7))))
        counts[k] = counts.get(k, 0) + 1
        truth[k] = truth.get(k, 0) + good
    sure = linking.calibrated(counts)
    for lo in (0.0, 0.2, 0.4, 0.6, 0.8):  # reliability: of the pairs with a confidence near x a share near x are matches
        some = [k for k in counts if lo <= sure[k] < lo + 0.2 + 1e-9]
        n = sum(counts[k] for k in some)
        if n > 300:
            assert abs(sum(truth[k] for k in some) / n - sum(counts[k] * sure[k] for k in some) / n) < 0.08
    assert linking.calibrated({}) == {}
