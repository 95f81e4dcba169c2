"""Small tables with nulls, empty and long texts, ties, copies and a clashing extra column."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, node string"


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = {"en": "the of and stone river light green paper under house walk".split(), "fr": "le la été garçon maison être où rivière lumière très".split()}
    shared = "This very line is found in many documents of the set"
    out = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        lines = [" ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "s", "ly", "ing"]) for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(1, 9))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["  ", "", "\t"]) + (shared if i % 8 else shared.upper()))
        out.append((i, "\n".join(lines), lang, f"host{i % 3}"))
    out += [(n, None, "en", "host0"), (n + 1, "", None, None), (n + 2, "   \n\t", "en", None), (n + 3, "12 34 !!", None, "host1"), (n + 4, "x" * 5000, "en", "host2")]
    copy = out[5][1]
    out += [(n + 5, copy, "en", "host0"), (n + 6, copy, "en", "host1"), (n + 7, copy.replace(" ", "  "), "en", "host1"), (n + 8, " ".join(["word"] * 4000), "en", "host2"), (n + 8, " ".join(["word"] * 4000), "en", "host2")]
    long = [rng.choice(vocabulary["en"]) + str(rng.randint(0, 999)) for _ in range(400)]
    near = long[:200] + ["changed"] + long[201:]
    out += [(n + 9, " ".join(long), "en", "host1"), (n + 10, " ".join(near), "en", "host1"), (n + 11, "Ünï çödé ☃ 😀 text", "fr", None)]
    return [(d, t, lang, s, None if t is None else len(t), 1.0, "clash", "clash") for d, t, lang, s in out]
