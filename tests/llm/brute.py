"""What the operators must give, worked out plainly in Python, and documents that are unlike any other."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, text_sha256 string, _row string, size long, copies int, bands string, label long, digest string, `left` long"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(r.randrange(40)) for _ in range(n))


def changed(text: str, every: int) -> str:
    return " ".join(w + "x" if k % every == every - 1 else w for k, w in enumerate(text.split(" ")))


def odd_texts() -> list[str | None]:
    long, base = prose(1, 60_000), prose(2, 300)
    chain = [base]
    for k in range(3):  # each is near the one before, the first and the last are not near each other
        words = chain[-1].split(" ")
        words[40 + 60 * k : 44 + 60 * k] = [f"new{k}{j}" for j in range(4)]
        chain.append(" ".join(words))
    return [
        None, "", " \t\n", "one", "one two three four", "ONE  two\tthree four", "one two three four five", "…¿?! 123", "　é́🙂 x", base, base, base.upper(), base.replace(" ", "\n"),
        changed(base, 150), changed(base, 7), long, long + " end", *chain[1:], "▁ ▁▁ <s> </s> <unk>", "a\x00b\x00", "ﬁ  Ａ  ²x_1", " lead and trail ", "x" * 5000, "日本語のテキスト" * 50, "Ein Satz. " * 400,
    ]


def odd_docs(spark):
    """Odd texts, twice, with repeated rows, null ids, sources and languages, and columns whose names clash."""
    rows = []
    for k, t in enumerate(odd_texts() * 2):
        rows.append((k + 10, t, [None, "en", "de"][k % 3], [None, "hot", "hot", "b"][k % 4], None if t is None else len(t)))
    rows += [rows[9], rows[3], (None, "no id here at all, none", "en", "b", 1), (None, None, None, None, None), (10, "another text under an id that is there", "en", "b", 1)]
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, "z", 4, "d", 5) for r in rows], DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def near(rows: list[tuple], percent: int) -> dict:
    """Smallest id that each id reaches, from all pairs; and the sets."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets_ = [(i, s) for i, s in sets if s]
    for k, (a, x) in enumerate(sets_):
        for b, y in sets_[:k]:
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    one, two = sorted((root(a), root(b)))
                    up[two] = one
    return {i: root(i) for i in up}
