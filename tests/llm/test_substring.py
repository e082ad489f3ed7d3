import random

import numpy as np
from pyspark.sql import functions as F

from common_data import docs_of, sf, sf_docs  # noqa: F401
from shopfloor.llm.substring import dedup_substrings, op2_substring, sentences

PASSAGE = ("it was a cold and rainy day in the small town by the sea. nobody had seen the sun for a week, and nobody "
           "expected it. the fishermen stayed at home, the shops were closed; only the old lamp keeper went out, as he "
           "did every day of the year, to look after the light that he had kept for forty years")


def brute(rows, k=2, m=20):
    """Text after removal, by comparing every run of at least ``k`` sentences and ``m`` words.
    Runs of one length get exact numbers; a run of n + 1 sentences repeats only if its first n do."""
    docs = [(d, sentences(t)) for d, t in sorted(dict(rows).items())]
    ids, number, words, ends = [], {}, [0], []
    for _, units in docs:
        for u in units:
            folded = "".join(c.lower() if c.isascii() else c for c in u.strip())
            ids.append(number.setdefault(folded, len(number)))
            words.append(words[-1] + len(folded.split()))
        ends += [len(ids)] * len(units)
    ids, words, ends = np.array(ids), np.array(words), np.array(ends)
    cover, at, run, n = np.zeros(len(ids) + 1, int), np.arange(len(ids)), ids.copy(), 1
    while len(at):
        _, first, group, count = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
        if n >= k:
            again = (at != at[first][group]) & (words[at + n] - words[at] >= m)
            np.add.at(cover, at[again], 1)
            np.add.at(cover, at[again] + n, -1)
        keep = (count[group] > 1) & (at + n < ends[at])
        at, run = at[keep], group[keep] * len(number) + ids[at[keep] + n]
        n += 1
    gone, out, i = np.cumsum(cover) > 0, {}, 0
    for (d, units), (_, text) in zip(docs, sorted(dict(rows).items()), strict=True):
        mine = gone[i:i + len(units)]
        out[d] = "".join(u for u, g in zip(units, mine) if not g) if mine.any() else text
        i += len(units)
    return out


def test_sentences_give_the_text_back():
    for t in ("", "a", "a. b! c", "  x,\n\ny;z ... \n", "漢字。かな、ok!?\t"):
        assert "".join(sentences(t)) == t


def test_equals_brute_force_on_the_table(spark, sf, sf_docs):
    got = {r.doc_id: r.text for r in op2_substring(spark, sf).collect()}
    assert got == brute([(d, t) for d, t, *_ in sf_docs])


def test_passages_inside_sentences_are_cut_from_all_but_the_first(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(rnd.choice(words) + (rnd.choice(".,") if rnd.random() < 0.15 else "") for _ in range(n))
    texts = [prose(80) + (f" {PASSAGE.upper() if i % 2 else PASSAGE} " if i % 3 == 0 else " ") + prose(80) for i in range(60)]
    rows = dedup_substrings(docs_of(spark, texts)).collect()
    for r in rows:
        if r.doc_id % 3 == 0 and r.doc_id:
            assert r.removed_sentences >= 5 and r.removed_words >= 30
            assert "nobody expected it" not in r.text.lower()
        else:
            assert r.removed_sentences == 0 and r.text == texts[r.doc_id]


def test_a_span_in_a_third_of_the_documents(spark):
    texts = [f"{PASSAGE}. own{i} text{i} here{i}" if i % 3 == 0 else f"just{i}, some{i}, words{i}" for i in range(900)]
    got = dedup_substrings(docs_of(spark, texts)).agg(F.sum((F.col("removed_sentences") > 0).cast("int"))).first()[0]
    assert got == 299


def all_runs(rows, k=2, m=20):
    """Sentences that stay when every run of at least k sentences and m words is compared."""
    seen, stay = set(), {}
    for d, text in rows:
        units = [u.strip() for u in sentences(text)]
        words = [len(u.split()) for u in units]
        gone = set()
        for i in range(len(units)):
            for j in range(i + k, len(units) + 1):
                if sum(words[i:j]) >= m:
                    run = tuple(units[i:j])
                    if run in seen:
                        gone.update(range(i, j))
                    seen.add(run)
        stay[d] = [u for x, u in enumerate(units) if x not in gone]
    return stay


def test_spans_cover_what_all_runs_cover(spark):
    rnd = random.Random(3)
    pool = [" ".join(f"v{i}w{j}" for j in range(rnd.choice((1, 1, 2, 3, 6, 12, 25)))) + "." for i in range(60)]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    for i in range(60):
        a = rnd.randint(0, 40)
        texts.append(" ".join([rnd.choice(pool), *pool[a:a + rnd.randint(2, 14)], rnd.choice(pool)]))
    want = all_runs(list(enumerate(texts)))
    got = {r.doc_id: [u.strip() for u in sentences(r.text)] for r in dedup_substrings(docs_of(spark, texts)).collect()}
    assert got == want and sum(map(len, want.values())) < sum(len(sentences(t)) for t in texts)
