import random

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "la", "mo")]


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows():
    """Nulls, empty texts, texts without words or letters, ties, repeated rows, one id with two texts, a very long text."""
    long = prose(5, 60_000)
    return [
        (1, prose(1, 60)),
        (2, None),
        (3, ""),
        (4, " \t\n \r\n"),
        (5, "12 34 !!"),
        (6, prose(1, 60)),
        (6, prose(1, 60)),
        (7, prose(7, 40)),
        (7, prose(8, 40)),
        (None, prose(9, 30)),
        (None, None),
        (8, long),
        (9, long + " tail"),
        (10, "x" * 300_000),
        (11, "one two"),
        (12, "One  TWO"),
        (13, "ein Wort\n\nÄÖÜ ß 日本   é"),
    ]


class Links:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
