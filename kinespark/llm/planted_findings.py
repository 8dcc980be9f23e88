"""Labelled findings for the secret scan: values whose kind is known because they were made, set into text.

A secret is drawn at random - keys in several alphabets, passwords with and without digits or signs, words spoiled by
digits - and a false positive is made of ordinary words, numbers, addresses, paths, names, calls and placeholders.
Both kinds stand behind the same names, separators and neighbouring words, so neither the place nor the length tells them
apart, and no label follows from a feature. Words come from the corpus that is scanned.
"""

from __future__ import annotations

import random
import string
from collections.abc import Sequence

HEX, LETTERS, ALNUM = "0123456789abcdef", string.ascii_lowercase, string.ascii_letters + string.digits
SIGNS = "!#$%&*?^~+@-_."
# Names that hold secrets, and what stands between a name and its value.
NAMES = ["token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "passphrase", "access_key", "auth_token", "credential", "private_key"]
LINKS = [' = "', ': "', "=", ": ", " = ", "='", " := '", '": "', " => '"]


def _some(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(low, high)))


def secret(rng: random.Random, words: Sequence[str]) -> str:
    kind = rng.randrange(9)
    if kind == 0:
        return _some(rng, HEX, 1, 1) + _some(rng, HEX, rng.choice([31, 39, 63]), 63)[: rng.choice([31, 39, 63])]
    if kind == 1:
        return _some(rng, ALNUM + "+/", 20, 60) + rng.choice(["", "=", "=="])
    if kind == 2:
        return rng.choice(["", "sk_live_", "key-", "ghp_"]) + _some(rng, ALNUM, 16, 40)
    if kind in (3, 4):
        return _some(rng, LETTERS, 6, 20)
    if kind == 5:
        return _some(rng, string.ascii_letters, 6, 20)
    if kind == 6:
        return _some(rng, ALNUM + SIGNS, 6, 18)
    if kind == 7:
        return rng.choice(words) + _some(rng, string.digits, 1, 4) + _some(rng, SIGNS, 1, 2)
    spoiled = [c if rng.random() > 0.4 else rng.choice(string.digits + SIGNS) for c in rng.choice(words) + _some(rng, LETTERS, 2, 5)]
    return "".join(spoiled)


def false_positive(rng: random.Random, words: Sequence[str]) -> str:
    kind = rng.choice([0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 9])
    one, two, three = (rng.choice(words) for _ in range(3))
    if kind in (0, 1):
        return rng.choice([one, one.capitalize(), one.upper()])
    if kind == 2:
        return rng.choice(["_", "-", ".", "/", "+"]).join([one, two, three][: rng.randint(2, 3)])
    if kind == 3:
        return one + two.capitalize() + three.capitalize() * rng.randint(0, 1)
    if kind == 4:
        return rng.choice([_some(rng, string.digits, 6, 24), f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                           f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", ".".join(str(rng.randint(1, 255)) for _ in range(4))])
    if kind == 5:
        number = rng.choice(["", str(rng.randint(1, 99)), f".{rng.randint(1, 2030)}", f"_{rng.randint(1, 99)}"])
        host = rng.choice(["", f"mail{rng.randint(1, 9)}.", f"{three}."]) + f"{two}.{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
        one = one[: rng.choice([1, 2, 3, 5, 20])]
        return rng.choice([f"{one}{number}@{host}", f"{one}.{rng.randint(0, 99):02d}@{host}", f"{one}.{three}{number}@{host}", f"https://www.{host}/{one}/{three}{number}", f"www.{host}",
                           f"http://{host}/{one}?page={rng.randint(1, 99)}"])
    if kind == 6:
        return f"/{one}/{two}/{three}" + rng.choice(["", ".html", ".txt", f".{one[:3]}"])
    if kind == 7:
        return rng.choice([f"{one}.{two}()", f"get_{one}({two})", f"{one}_{two}[0]", f"${{{one.upper()}_{two.upper()}}}", f"<{one}-{two}>"])
    if kind == 8:
        return rng.choice("x*.-=_a0") * rng.randint(6, 40)
    return f"{one}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"


def planted(words: Sequence[str], count: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, length, label): ``count`` findings of each kind in turn, each in a text of its own.

    Values are at least 6 characters long, as candidates are. Without words of three letters a few of nonsense serve.
    """
    rng = random.Random(seed)
    words = sorted(w for w in words if len(w) >= 3) or ["lorem", "ipsum", "dolor"]
    out = []
    while len(out) < 2 * count:
        label = (len(out) + 1) % 2
        value = (secret if label else false_positive)(rng, words)
        if len(value) < 6:
            continue
        around = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(2)]
        if rng.random() < 0.7 or len(value) < 16:
            link = rng.choice(LINKS)
            before = around[0] + rng.choice([" ", "\n", ""]) + rng.choice(["", "my_", "DB_", "user."]) + rng.choice(NAMES) + link
            after = (link[-1] if link[-1] in "\"'" else "") + rng.choice([" ", "\n", "\r\n", ""])
        else:
            before, after = around[0] + rng.choice([" ", "\n", ' "']), rng.choice([" ", "\n", '" ', ", "])
        out.append((before + value + after + around[1], len(before), len(value), label))
    return out
