import random

from pyspark.sql import functions as F

from spanwright.functions import spans as S
from spanwright.functions.markdown import fenced_regions, parse_headings


PLAIN = ["words", "", "#tag", "####### seven", "    ```", "```js`x", "a ``` b", "\t# indented", "| # | ~~~ |"]
INSIDE = ["# not a heading", "plain", "", "``", "~~", "    ````````", "    ~~~~~~~~"]


class Page:
    """A text written block by block, so that its fences and headings are known without reading it."""

    def __init__(self, rnd):
        self.rnd, self.text, self.fences, self.heads = rnd, "", [], []

    def line(self, line):
        start = len(self.text)
        self.text += line + "\n"
        return start

    def filler(self):
        for _ in range(self.rnd.randrange(3)):
            if self.rnd.random() < 0.4:
                self.fence()
            else:
                self.line(self.rnd.choice(PLAIN))

    def fence(self, closed=True):
        rnd = self.rnd
        kind, size = rnd.choice("`~"), rnd.randint(3, 5)
        other = {"`": "~", "~": "`"}[kind]
        start = self.line(" " * rnd.randrange(4) + kind * size + rnd.choice(["", " ", "py", " a b"]))
        for _ in range(rnd.randrange(4)):
            self.line(rnd.choice([*INSIDE, kind * (size - 1), other * 6, kind * size + " open"]))
        if closed:
            self.line(" " * rnd.randrange(4) + kind * (size + rnd.randrange(2)) + rnd.choice(["", "  "]))
        self.fences.append((start, len(self.text) - 1))

    def section(self, level, path):
        title = self.rnd.choice(["Pump", "Two words", "", "Caf\u00e9 \U0001f600", "x # y"])
        path = [*path, title]
        start = self.line("#" * level + (self.rnd.choice([" ", "\t", "  "]) + title + self.rnd.choice(["", " "]) if title else ""))
        self.heads.append((path, level, len(self.text), start))
        self.filler()
        self.sections(level, path)

    def sections(self, level, path):
        # of two sections side by side the later one can't be the deeper one, or it would lie in the earlier
        below = 6
        for _ in range(self.rnd.randrange(3)):
            if level < below:
                below = self.rnd.randint(level + 1, min(below, level + 2))
                self.section(below, path)

    def done(self):
        """The text, without its last line end, its fences and its headings; a heading's body ends where the next begins."""
        text = self.text[:-1]
        ends = ([start for *_, start in self.heads[1:]] + [len(text)])[: len(self.heads)]
        return text, self.fences, [(path, level, body, end) for (path, level, body, _), end in zip(self.heads, ends, strict=True)]


def page(seed):
    made = Page(random.Random(seed))
    made.filler()
    made.sections(0, [])
    if seed % 3 == 0:
        made.fence(closed=False)
    else:
        made.line("end")
    return made.done()


def run(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", fenced_regions(F.col("t")).alias("f"), parse_headings(F.col("t")).alias("h")).collect()
    return [(r.t, [tuple(x) for x in r.f], [(list(x.path), x.level, x.start, x.end) for x in r.h]) for r in rows]


def test_cases(spark):
    cases = [
        ("# Fan\n\nblows\n\n### Noise\n\nlow", [], [(["Fan"], 1, 6, 14), (["Fan", "Noise"], 3, 24, 28)]),
        ("## b\n# a\n## c", [], [(["b"], 2, 5, 5), (["a"], 1, 9, 9), (["a", "c"], 2, 14, 13)]),
        ("#", [], [([""], 1, 2, 1)]),
        ("~~~\n# x\n```\n~~~~ \n# y", [(0, 17)], [(["y"], 1, 22, 21)]),
        ("a\n```\n# x", [(2, 9)], []),
        ("", [], []),
    ]
    assert run(spark, [t for t, *_ in cases]) == cases


def test_written_pages(spark):
    pages = [page(seed) for seed in range(600)]
    assert run(spark, [t for t, *_ in pages]) == pages


def test_null_text(spark):
    assert spark.createDataFrame([(None,)], "t string").select(parse_headings(F.col("t"))).first()[0] is None


def test_occurrences_overlap(spark):
    rnd = random.Random(1)
    pairs = [("aaa", "aa"), ("", "a"), ("a", ""), ("x\\Ey\\Ez", "\\E"), ("a.b.c", "."), ("abc", "abcd"), ("\U0001f600a\U0001f600a", "a")]
    pairs += [("".join(rnd.choice("ab") for _ in range(12)), "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "t string, n string").select("t", "n", S.occurrences(F.col("t"), F.col("n")).alias("o")).collect()
    for r in rows:
        assert r.o == [i for i in range(len(r.t)) if r.n and r.t.startswith(r.n, i)], (r.t, r.n)


def test_suffix_and_resolving(spark):
    cases = [([], [], 0, True), ([], ["a"], 0, False), (["a"], [], 0, False), (["x", "t"], ["y", "t"], 1, True), (["a", "x", "t"], ["a", "y", "t"], 1, True), (["t"], ["b", "t"], 1, True), (["t", "u"], ["t", "v"], 0, False), (["a", "b"], ["a", "b"], 2, True)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in cases], "a array<string>, b array<string>")
    rows = df.select(S.common_suffix(F.col("a"), F.col("b")), S.paths_resolve(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(n, ok) for *_, n, ok in cases]


def test_paragraphs(spark):
    text = "one\ntwo\n\n \t\nthree\n"
    got = spark.createDataFrame([(text,)], "t string").select(S.paragraphs(F.col("t"), F.lit(0), F.char_length("t"))).first()[0]
    assert [tuple(p) for p in got] == [("one\ntwo", 0, 7), ("three", 12, 17)]
