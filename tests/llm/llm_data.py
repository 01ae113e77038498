"""Small hostile tables, and plain words for brute-force versions."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns are named as the operators name theirs.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, root string, size long, draw double, key string, h int, at int, w string"

LOREM = "the quick brown fox jumps over the lazy dog while seven wizards brew a bitter potion near the old stone mill and nobody in town seems to mind"
BON = "les enfants du village jouent près de la rivière pendant que leurs parents préparent le repas du soir dans la grande maison blanche"
ODD = [
    (1, LOREM, "en", "a"),
    (2, LOREM.upper(), "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \n\t ", "fr", None),
    (6, "12 34 --- !!", None, None),
    (7, "one", "en", "b"),
    (8, "Ünïcödé wörds \U0001f600 and 中文 字 a b c\x1cd", None, "c"),
    (9, BON, "fr", "c"),
    (9, BON, "fr", "c"),
    (10, (LOREM + "\n") * 300, "en", "b"),
    (None, LOREM, None, None),
    (None, "secret: 'abcdef123'  token=zzzzzzzz AKIA" + "Q" * 16, "en", ""),
    (11, "a  b \n c\n\n" + BON + "\n" + LOREM, "fr", "c"),
    (12, "x" * 5000, "en", "a"),
]


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(*r, 0, 7, 7, "x", 7, 0.5, "k", 7, 7, "w") for r in rows], SCHEMA)


def no_docs(spark):
    return odd_docs(spark, [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Sets:
    """Union-find whose representative is the smallest member."""

    def __init__(self, n):
        self.to = list(range(n))

    def find(self, x):
        while self.to[x] != x:
            self.to[x] = self.to[self.to[x]]
            x = self.to[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.find(x), self.find(y)))
        self.to[y] = x
