"""A second, scalar reading of the linkage formula, for comparison."""

from math import floor

ALPHABET = "abcdefghijklmnopqrstuvwxyz -."
WEIGHTS = {"name": 13.16, "city": 5.44, "postcode": 5.47, "birth_day": 3.6, "birth_month": 3.59, "birth_year": 3.52}
FIELDS = ("first_name", "surname", "birth_name", "city", "postcode", "birth_day", "birth_month", "birth_year")


def symbols(text: str) -> str:
    return "".join(c if c in ALPHABET else "?" for c in "".join(chr(b).lower() if b < 128 else "?" for b in text.encode()))


def grams(text: str) -> list[str]:
    p = f" {symbols(text)} "
    return [p[i : i + 2] for i in range(len(p) - 1)]


def score(x: dict, y: dict, fixed: bool = True):
    unit = 256 if fixed else 1
    cut = floor if fixed else (lambda v: v)
    num = den = 0
    for name, parts in (("name", FIELDS[:3]), ("city", FIELDS[3:4])):
        has = min(cut(sum(r[p] != "" for p in parts) / len(parts) * unit) for r in (x, y))
        a, b = (grams(" ".join(r[p] for p in parts)) for r in (x, y))
        w = cut(WEIGHTS[name] * unit)
        num += cut(2 * len(set(a) & set(b)) * has * w / unit)
        den += cut((len(a) + len(b)) * has * w / unit)
    for name in FIELDS[4:]:
        if x[name] and y[name]:
            w = cut(WEIGHTS[name] * unit)
            den += w
            num += w * (x[name] == y[name])
    t = cut(0.8 * unit)
    return num, den, den > 0 and num > cut(t * den / unit)
