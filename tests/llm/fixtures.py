"""Documents that are hard on purpose, and plain Python versions of what the operators compute."""

import re

SPACE = re.compile(r"[\x20\x09-\x0d]+")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
# Extra columns whose names the operators use themselves.
EXTRA = ["size", "shard", "rank", "k", "none", "n", "print", "kept", "length", "score", "label", "target", "place", "_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)

PROSE = ("The old harbour lies below the hill and the boats come home at dusk when the bells of the small church ring "
         "over the roofs. Children run along the wall, count the masts and wave at the men who carry nets and baskets "
         "up the narrow steps to the market square where lamps are lit one after another until the night is warm. ")


def rows():
    texts = [
        (1, PROSE, "src0"), (2, PROSE, "src1"), (3, PROSE.replace(" ", "\n\t "), "src0"), (4, None, "src0"), (5, "", None),
        (6, " \t ", "src2"), (7, "one", "src2"), (8, "Two WORDS", "src10"), (9, "two words", None), (None, PROSE, "src0"),
        (None, None, None), (None, "no id", "src1"), (10, "é́ 漢字 😀 \x00 ▁x ﬁ", "src3"), (11, PROSE * 400, "src0"),
        (12, "a" * 30_000, "src0"), (13, PROSE.replace("dusk", "dawn"), "src1"), (13, PROSE.replace("dusk", "dawn"), "src1"),
        (14, "repeated row", "src0"), (14, "repeated row", "src0"), (14, "repeated row", "src0"), (14, "same id", "src0"),
        (15, 'password="hunter2hunter2" and token: short', "src4"), (16, "AKIA" + "A1B2" * 4 + " 😀 deadbeef" + "0f" * 16, "src4"),
        (17, "api_key = secret: abcdefghij", "src4"), (18, "Api-Key PASSWD:\x27x1y2z3w4v5\x27", "src4"), (-5, "negative id", "src0"),
        (2**62, "large id", "src0"), (19, PROSE + PROSE[:40], "src1"),
    ]
    return [(i, t, None if s is None else "en", s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, s in texts]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(5)


def words(text):
    return WORD.findall(lowered(text or ""))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def squeezed(text):
    return SPACE.sub(" ", text or "")


def shingles(text, width):
    found = WORD.findall(text or "")
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[k:k + width]) for k in range(len(found) - width + 1)}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)
