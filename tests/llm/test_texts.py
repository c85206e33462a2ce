import random

import numpy as np
import pytest
import tiktoken

from quernstone.llm import bpe, spans
from quernstone.llm.bpe import token_counts, token_ids
from quernstone.llm.mixing import mix_sources
from quernstone.llm.spans import shared_spans

RANKS = bpe.read_ranks(bpe.RANKS)


@pytest.fixture(scope="module")
def judge():
    return tiktoken.Encoding("judge", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(RANKS)


def odd_texts():
    rng = random.Random(1)
    letters = "aab \n\té日本🙂1²\x00\x1c   !'s'll<|endoftext|>ßΩж"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(200)]


def test_ids_equal_the_public_encoder(judge, vocab):
    texts = [*odd_texts(), "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 700, "日本語" * 400, "x", ""]
    ids, sizes = bpe.Encoder(vocab).encode(texts)
    ends = np.cumsum(sizes)
    for t, n, e in zip(texts, sizes, ends):
        assert ids[e - n : e].tolist() == judge.encode_ordinary(t), t[:80]
    assert bpe.Encoder(vocab).count(texts).tolist() == sizes.tolist()


def test_a_word_of_any_length_is_merged_alike(judge, vocab):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "ab" * 9_000, "aaaab" * 3_000 + "é" * 5_000, "x"]
    want = [judge.encode(w, disallowed_special=()) for w in words]
    for longest in (4096, 10**9):
        ids, n = bpe.encode_words([w.encode() for w in words], vocab, longest)
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == want
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 70_000})


def test_forgetting_words_changes_nothing(vocab):
    texts = odd_texts()
    small, large = bpe.Encoder(vocab, most_words=10), bpe.Encoder(vocab)
    for part in (texts[:90], texts[90:], texts[:50]):
        a, b = small.encode(part), large.encode(part)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_a_very_long_text_is_whole(judge, vocab):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(250_000))
    assert len(text) > 1_000_000
    assert bpe.Encoder(vocab).encode([None, text, "tail"])[0].tolist() == judge.encode_ordinary(text) + judge.encode_ordinary("tail")


def test_token_ids_of_a_table(spark, judge):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (None, "a  b", "x")]
    got = [(r.doc_id, r.ids) for r in token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()]
    want = [(i, judge.encode_ordinary(t or "")) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    counts = token_counts(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    assert sorted((r.doc_id or 0, r.ids, r.n_tokens) for r in counts.collect()) == sorted((i or 0, "x", len(judge.encode_ordinary(t or ""))) for i, t, _ in rows)


# --- mixing


def mixed(spark, rows, targets, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, site string, repeats int")
    goal = spark.createDataFrame(targets, "source string, weight_permille int, max_repeats int")
    mix, report = mix_sources(docs, goal, **kw)
    return {r.doc_id: (r.source, r.repeats) for r in mix.collect()}, {r.source: r for r in report.collect()}


def corpus(n, source, lang="en", site="a.com", start=0, words=20):
    rng = random.Random(start)
    return [(start + i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(words)), source, lang, site, 0) for i in range(n)]


def test_shares_are_met_and_caps_kept(spark):
    rows = corpus(600, "big") + corpus(100, " SMALL ", "de-AT", "b.de", 1000) + corpus(30, "Tiny", None, None, 2000) + corpus(50, "other", start=3000) + corpus(5, None, start=4000)
    rows += [(5000, None, "big", "en", "a.com", 0), (5001, "", "small", "en", "a.com", 0)]
    mix, rep = mixed(spark, rows + rows[:90], [("big", 500, 3), ("small", 300, 4), ("tiny", 200, 2), ("gone", 100, 5)], slots=16)
    total = sum(rep[s].tokens for s in ("big", "small", "tiny"))
    assert rep["tiny"].exhausted and rep["gone"].exhausted and not rep["big"].exhausted and not rep["small"].exhausted
    assert rep["tiny"].taken_tokens == 2 * rep["tiny"].tokens and rep["gone"].tokens == 0
    assert abs(sum(r.taken_tokens for r in rep.values()) - total) < 200
    assert rep["small"].taken_tokens <= 4 * rep["small"].tokens and rep["big"].taken_tokens >= rep["big"].target_tokens
    assert max(k for s, k in mix.values() if s == "small") <= 4 and {k for s, k in mix.values() if s == "tiny"} == {2}
    assert set(s for s, _ in mix.values()) == {"big", "small", "tiny"}
    again, _ = mixed(spark, rows[::-1], [("big", 500, 3), ("small", 300, 4), ("tiny", 200, 2), ("gone", 100, 5)], slots=16)
    assert again == mix


def test_shortage_goes_to_siblings_first(spark):
    # x and y share domain and language, z is elsewhere; x is short
    rows = corpus(20, "x", start=0) + corpus(400, "y", start=1000) + corpus(400, "z", "fr", "b.fr", 2000)
    _, rep = mixed(spark, rows, [("x", 400, 1), ("y", 300, 9), ("z", 300, 9)])
    assert abs(rep["z"].taken_tokens - rep["z"].target_tokens) < 60
    assert rep["y"].taken_tokens > rep["y"].target_tokens * 1.5


def test_mix_of_nothing(spark):
    mix, rep = mixed(spark, [], [("x", 400, 1)])
    assert mix == {} and not rep["x"].exhausted and rep["x"].taken_tokens == 0


# --- spans


def brute(rows, width):
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t or "")
    seen = {}
    for i, ts in texts.items():
        for t in ts:
            for k in range(len(t) - width + 1):
                seen.setdefault(t[k : k + width], set()).add(i)
    out = {}
    for i, ts in texts.items():
        best = (0, 0)
        for t in ts:
            chars, n, end = 0, 0, -1
            for k in range(len(t) - width + 1):
                if len(seen[t[k : k + width]]) > 1:
                    n += k > end
                    chars += k + width - max(k, end)
                    end = k + width
            best = max(best, (chars, n))
        out[i] = best
    return out


def span_rows(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefgé日🙂 ") for _ in range(n))

    shared = [noise(120), noise(45), noise(41), "=" * 300]
    rows = []
    for i in range(60):
        t = noise(rng.randrange(0, 200))
        for s in shared:
            if rng.random() < 0.4:
                cut = rng.randrange(0, 30)
                t += s[cut : cut + rng.randrange(20, 120)] + noise(rng.randrange(0, 60))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, noise(39)), (103, rows[3][1] + rows[3][1]), (104, "z" * 500), (105, "zz" * 90), (106, "q" * 300), (3, rows[3][1]), (7, noise(200)), (None, shared[0])]
    return rows


@pytest.mark.parametrize("crowd,longest", [(4000, 256), (1, 256), (3, 16)])
def test_spans_against_brute_force(spark, crowd, longest):
    rows = span_rows(5)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, _z string, _run int").repartition(5)
    got = {r.doc_id: (r.shared_chars, r.n_spans) for r in shared_spans(df, width=40, least=8, longest=longest, crowd=crowd).collect()}
    assert got == brute(rows, 40)
    assert got[106] == (0, 0) and got[104][0] == 500


def test_spans_of_nothing(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = shared_spans(spark.createDataFrame([(1, "a" * 1000), (1, "a" * 1000), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_chars, r.shared_chars, r.shared_permille) for r in one} == {(1, 1000, 0, 0), (2, 0, 0, 0)}


def test_every_window_is_in_one_run():
    texts = [t for _, t in span_rows(2) if t and len(t) >= 40]
    row, first, run, mini, _, _ = spans.super_kmers(texts, 40, 8, 16)
    for i, t in enumerate(texts):
        own = sorted((f, n) for r, f, n in zip(row, first, run) if r == i)
        assert [f for f, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) == len(t) - 39
    assert run.max() <= 16 and len(set(mini)) > 1


def test_long_texts_are_cut_into_pieces_that_share_no_window():
    text = "".join(random.Random(3).choice("ab") for _ in range(1000))
    pieces = list(spans._pieces(["x" * 30, text, "short"], 20, 64))
    starts = [s + k for i, s, p in pieces if i == 1 for k in range(len(p) - 19)]
    assert starts == list(range(981)) and all(text[s : s + len(p)] == p for i, s, p in pieces if i == 1)
    assert [p for i, _, p in pieces if i != 1] == ["x" * 30]
