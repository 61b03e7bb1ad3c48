"""A small corpus with the awkward cases: nulls, empty and long texts, copies, ties, repeated ids, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, did long, key string, n int"
WORDS = "the of and to in that was his with for had you not are but from or have an they which one were all her would there been their we him said who will more no if out so up into than them can only other time new some could these two may first then do any like now".split()


def passage(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", rng.choice("abcdefgh")]) for _ in range(n))


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    out: list[tuple[int | None, str | None]] = []
    shared = passage(rng, 70)
    base = passage(rng, 120)
    for k in range(40):
        out.append((k, passage(rng, rng.randint(5, 150)).replace(" so ", ".\n")))
    for k in range(40, 52):  # near copies of one text
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(6)}"
        out.append((k, " ".join(words)))
    for k in range(52, 58):  # exact copies, some only up to white space
        out.append((k, base if k % 2 else base.replace(" ", "  ")))
    for k in range(58, 64):  # a passage that several texts share
        out.append((k, passage(rng, 60) + "\n" + shared + "\n" + passage(rng, 30)))
    line = "This line is in many of the texts."
    for k in range(64, 70):
        out.append((k, f"{passage(rng, 20)}\n  {line.upper() if k % 2 else line} \n{passage(rng, 12)}\nshort\n{line}"))
    out += [(70, None), (71, ""), (72, " \t\n "), (73, "one two three"), (74, "One  two three"), (75, "x"), (76, "\n\n\n"), (77, "spam " * 300)]
    out += [(78, passage(rng, 6000)), (79, "Grün ÄÖÜ straße, É école — don't! 12 a|b|c # * $ % & <x>\r\nGrün ÄÖÜ straße, É école — don't!")]
    out += [(80, "Released under the MIT License.\nLicensed under CC BY-NC 4.0. The Apache License"), (81, "gnu General PUBLIC license gnu general public license"), (82, "Permission is hereby granted, free of charge, to any person obtaining a copy of software and associated documentation")]
    out += [(None, base), (None, "only this"), (5, "a second row of this id " + passage(rng, 20)), (5, "a second row of this id"), (0, out[0][1])]
    out += [(k, passage(rng, 40) + rng.choice(["\nyou are an idiot.", ", you stupid clown", " they are scum!"]) if k % 3 == 0 else passage(rng, 40)) for k in range(100, 160)]
    return out


def rows(seed: int = 3) -> list[tuple]:
    langs, sources = ["en", "de", None, "fr"], ["src0", "src0", "src0", "src1", None, "src2"]
    return [(i, t, langs[k % 4], sources[k % 6], len(t or ""), "w", 7, "k", 1) for k, (i, t) in enumerate(texts(seed))]
