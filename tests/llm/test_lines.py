import random
import re
from collections import defaultdict

from common_data import docs_of, sf, sf_docs  # noqa: F401
from shopfloor.llm.lines import dedup_lines, op5_lines


def brute(rows, min_texts=10, depth=3, constant=0.5, exact_tokens=5):
    """The tree, leaf by leaf; texts are told apart by themselves."""
    texts = {t for _, t in rows if t}
    tokens = lambda line: ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", line) if t]
    leaf = lambda t: (len(t), tuple(t[:depth]))
    at = defaultdict(set)
    for text in texts:
        for line in text.split("\n"):
            t = tokens(line)
            for i, x in enumerate(t):
                at[(leaf(t), i, x)].add(text)

    def template(line):
        t = tokens(line)
        fixed = [(i, x) for i, x in enumerate(t) if len(at[(leaf(t), i, x)]) >= min_texts]
        plain = sum(x != "<*>" for _, x in fixed)
        return (leaf(t), tuple(fixed)) if t and plain >= constant * len(t) else None
    of = defaultdict(set)
    for text in texts:
        for line in text.split("\n"):
            of[template(line)].add(text)
    drop = {k for k, v in of.items() if k and len(v) >= min_texts}
    raw = lambda line: tuple(t for t in re.split(r"[\x20\x09-\x0D]+", line) if t)
    first = {}
    for _, text in sorted((d, t) for d, t in rows if t):
        for line in text.split("\n"):
            first.setdefault(raw(line), text)
    again = lambda line, text: len(raw(line)) >= exact_tokens and first[raw(line)] != text
    out = {}
    for d, text in rows:
        if text:
            kept = [x for x in text.split("\n") if template(x) not in drop and not again(x, text)]
            text = "\n".join(kept) if len(kept) < len(text.split("\n")) else text
        out[d] = text
    return out


def test_equals_brute_force_on_the_table(spark, sf, sf_docs):
    got = {r.doc_id: r.text for r in op5_lines(spark, sf).collect()}
    want = brute([(d, t) for d, t, *_ in sf_docs])
    assert got == want and got != {d: t for d, t, *_ in sf_docs}


def test_variable_fields_are_generalised(spark):
    rnd = random.Random(1)
    names = [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    texts = []
    for i in range(60):
        own = "\n".join(" ".join(rnd.choice(names) for _ in range(12)) for _ in range(4))
        log = f"page last changed on {rnd.randint(1, 30)} may by {rnd.choice(names)} of the team"
        texts.append(f"{own}\n{log}\n\nshared footer line" if i % 2 else own)
    rows = {r.doc_id: r for r in dedup_lines(docs_of(spark, texts)).collect()}
    for i, r in rows.items():
        assert r.dropped_lines == (2 if i % 2 else 0)
        assert "changed" not in r.text and "footer" not in r.text
        assert r.text.split("\n")[:4] == texts[i].split("\n")[:4]
    assert {d: r.text for d, r in rows.items()} == brute(list(enumerate(texts)))


def test_copies_of_a_text_keep_their_lines(spark):
    texts = ["the same text\nwith two lines"] * 50 + ["a line of its own here\nfooter of all texts"] + [f"own{i}x\nfooter of all texts" for i in range(12)]
    rows = dedup_lines(docs_of(spark, texts)).collect()
    assert all(r.dropped_lines == (0 if r.doc_id < 50 else 1) for r in rows)


def test_a_line_of_a_third_of_the_documents(spark):
    texts = [f"own {chr(97 + i % 26)}{i // 26 * 'z'}\nhot line of many" if i % 3 == 0 else f"other {i * 'q'}" for i in range(300)]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_an_exact_line_stays_in_its_first_text(spark):
    line = "in 2024 a line of seven words"
    texts = [f"own words\n{line}", f"other words\n  {line} ", f"own words\n{line}", "too short a line", "too short a line\nb",
             "in 2025 a line of seven words", None, "", f"{line}\n{line}"]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)))
    assert got[0] == got[2] == texts[0] and got[1] == "other words" and got[8] == "" and got[4] == texts[4] and got[5] == texts[5]


def test_recall_of_exact_lines(spark, sf, sf_docs):
    """Lines of five or more words in two or more different texts: none is left outside its first text."""
    rows = [(d, t) for d, t, *_ in sf_docs]
    got = {r.doc_id: r.text for r in op5_lines(spark, sf).collect()}
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 5:
                holders[" ".join(re.findall(r"[^\x20\x09-\x0D]+", x))].add(t)
    repeated = {x for x, texts in holders.items() if len(texts) > 1}
    left = defaultdict(set)
    text_of = dict(rows)
    for d, t in got.items():
        for x in (t or "").split("\n"):
            if " ".join(x.split()) in repeated:
                left[" ".join(x.split())].add(text_of[d])
    assert repeated and all(len(texts) == 1 for texts in left.values())
