"""Texts for the tests of the text operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "de", "fi", "go", "lu", "ma", "ne", "ro") for b in ("n", "st", "rk", "la", "mi", "tor", "é", "ß")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS) * (rng.random() < 0.5))
        if rng.random() < 0.05:
            out[-1] += ".\n" + rng.choice("ABC")
    return " ".join(out)


def changed(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def make_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Prose with copies, near copies, shared passages, repeated lines, nulls, empty and very long texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(1, 160)) for _ in range(n)]
    passage = prose(rng, 60)
    for k in range(6):
        texts.append(texts[k])
        texts.append(changed(rng, texts[k + 6] or "", 0.03))
        texts.append(prose(rng, 20) + " " + passage + " " + prose(rng, 20))
        texts.append("Some longer line that stands in many texts.\n" + prose(rng, 15) + f"\nPage {k} of the printed report, see there")
    texts += [None, "", " \n\t ", "one", "one two", "One  two", "a a a a a a a a a a a a", prose(rng, 6000), "x" * 3000, "<|endoftext|> kept", "trail \n", "é" * 120, None, ""]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
