"""Text measures of each document, and what they tell it to be: prose, list, table or junk.

A Gaussian mixture is fitted by expectation-maximisation to the standardised measures of all documents; its components
start at inspected examples and take their class from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans import cut, spread, staged, with_fields

# Phrases of site furniture (menus, notices, sharing bars).
FURNITURE = (
    r"(?i)^\W*(?:accept (?:all )?cookies?|cookies?(?: settings| policy)?|log ?in|log ?out|sign (?:in|up)|next|prev(?:ious)?|back to top|share\b.*|print\b.*|home\b.*|menu|search|subscribe|loading\b.*|click here\b.*|read more"
    r"|all rights reserved.*|terms(?: of (?:use|service))?|privacy policy|contact us|about us|skip to content|follow us.*|(?:©|\(c\)|copyright)\W*\d{4}.*|0x\w+|\[ ?\w+ ?\])\W*$"
)
BULLET = r"^\s*(?:[-*•+–◦▪]|\d{1,3}[.)]|[a-z][.)]|\[[ xX]\])\s+\S"
KEY_VALUE = r"^\s*[\p{L}\d][\p{L}\d_ ./-]{0,38}(?::|\s=)\s+\S.{0,60}$"
#: Cells parted by semicolons or commas, the line not a sentence; bars, tabs and columns are tested without a pattern.
ROW = r"^[^.;]{0,40};[^;]{0,40};.*$|^[^,]{1,30}(?:,[^, ][^,]{0,30}){3,}$"
LIST_ITEM_WORDS = 6
#: Words of a window of distinct_word_ratio, so that long texts compare with short ones.
WINDOW_WORDS = 200
CONSONANT = "[\\p{L}&&[^aeiouyåäöæøéèêëüáàâãíìîïóòôõúùûœ]]"
#: Words without a vowel, with five consonants in a row, or longer than any word.
ODD_WORD = rf"(?<!\p{{L}})(?:{CONSONANT}{{3,}}(?!\p{{L}})|\p{{L}}*?{CONSONANT}{{5}}\p{{L}}*|\p{{L}}{{25,}})"

#: The measures, in the order of the model.
MEASURES = [
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "long_token_share", "odd_word_share", "common_word_share", "punctuated_share",
    "bullet_share", "key_value_share", "row_share", "short_line_share", "long_line_share", "furniture_share", "repeated_line_share", "distinct_word_ratio", "broken_char_ratio",
]

# The inspected examples: (class, text).
EXAMPLES: list[tuple[str, str]] = [
    ("prose", "The team met on Tuesday to talk about the plan. Nobody was sure that the first part would be ready in time, but all of them wanted to try. After an hour they had found three ways to go on, and one of them was cheap."),
    ("prose", "Notes\nWhen the water level rises in spring, the lower road is closed for a week or two. People who live there use the old path along the hill.\nIt takes longer, but it is the only way that is left. Some of them have asked for a bridge, and the town has said that it will think about it."),
    ("prose", "the speaker says that most of the problems come from the way we measure them and not from the things themselves and he goes on to show how two groups that were given the same numbers came to quite different ends because one of them had been told what to look for"),
    ("prose", "ALL OF THE ROOMS ON THIS FLOOR MUST BE CLEAN BEFORE THE GUESTS ARRIVE. IF ONE OF THEM IS NOT, PLEASE TELL THE OFFICE AS SOON AS YOU CAN. THE KEYS ARE WITH THE PORTER."),
    ("prose", "Det er ikke lenge siden vi fikk den første meldingen om dette, og ingen har sagt noe om hva som skal gjøres. Jeg tror at det kan vente til neste uke. Hvis du har tid, kan du se på det i morgen."),
    ("prose", "Nous ne savons pas encore si le travail sera fini avant la fin du mois. Il faut attendre que les autres aient donné leur avis, et ce n'est pas pour demain. Dans tous les cas, la route reste ouverte."),
    ("prose", "Wir haben lange auf die Antwort gewartet, aber sie ist nicht gekommen. Es ist noch nicht klar, wer das Geld hat und was damit geschehen soll. Wenn man ihn fragt, sagt er immer das Gleiche."),
    ("prose", "h2. Summary\n\nWe have two weeks left and most of the work is done. The rest depends on the people in the north, who have not yet said when they will come.\n- bring the maps\n- ask for the key\nAfter that we can start at once, and with some luck it will be over before the summer."),
    ("list", "Things to bring\n- warm coat\n- two blankets\n- spare lamp\n- bread knife\n- rope\n- matches\n- water bottle\n- sleeping bag"),
    ("list", "* red apple\n* green pear\n* dried fig\n* black cherry\n* sweet plum\n* wild strawberry"),
    ("list", "1. morning train\n2) stone bridge\n3. quiet harbour\n4) narrow street\n5. grey tower\n6) open market\n7. corner shop\n8) old mill"),
    ("list", "- [ ] paint the fence\n- [x] broken window\n- [ ] garden gate\n- [x] roof tiles\n- [ ] front door\n- [ ] cellar stairs"),
    ("list", "host-one: main server\nhost-two: backup copy\nhost-three: test machine\nhost-four: mail relay\nhost-five: print queue\nhost-six: old storage\nhost-seven: spare disk"),
    ("list", "Our rooms\nSunny corner room\nQuiet garden room\nLarge family suite\nSmall attic room\nBlue harbour view\nOpen kitchen studio\nStone cellar flat"),
    ("table", "| name | n | share | state |\n|---|---|---|---|\n| north-gate | 4521 | 12.50 | open |\n| south-gate | 883 | 71.02 | closed |\n| west-gate | 2210 | 9.75 | n/a |\n| east-gate | 19 | 44.10 | open |"),
    ("table", "name\tn\tshare\tstate\nnorth-gate\t4521\t12.50\topen\nsouth-gate\t883\t71.02\tclosed\nwest-gate\t2210\t9.75\tn/a\neast-gate\t19\t44.10\topen"),
    ("table", "north-gate;4521;12.50;open\nsouth-gate;883;71.02;closed for repair\nwest-gate;2210;9.75;n/a\neast-gate;19;44.10;open\nmill-gate;7410;3.33;open"),
    ("table", "north-gate              4521     12.50  open\nsouth-gate               883     71.02  closed for repair\nwest-gate               2210      9.75  n/a\neast-gate                 19     44.10  open"),
    ("junk", "#8!2 *=?4 ~~/1 3$0@ 7|-<\\ 95%^ &2_+ =81? @@4 /#6- ^3~0 *1*9 $$?2 <5>7 -|=8 0%%4 +6_# !3~^ 2&8? |9/1 ~5*= 4@<7 #0-6"),
    ("junk", "xqzt vkrwl bpdfg htrnk wzzxq lkjfd qwrtp mnbvc zxcvb gfdsq ptrwq hjklm vbnmq wrtzp dfghk sqrtv bcxzl knmtr qzpwx tgbrv yhnsd plkmz qrvtx"),
    ("junk", "Header-line\nQk9aWmF0UjdoTm1YcExzVnVFd0t5QjJjRGZHOXRKaUFvM1I0\nbU5wUThzVHVWd1h5WjAxMjM0NTY3ODlhYmNkZWZnaGlqa2xt\nS2xNbk9wUXJTdFV2V3hZejAxMjM0NTY3ODlBQkNERUZHSElK\nWlhDVkJOTUFTREZHSEpLTFFXRVJUWVVJT1AxMjM0NTY3ODkw"),
    ("junk", "Ã¦bÃ¸ cÃ¥¤ ð\x9f\x98 Â¶Â§d â€™zÃ¶ bÃÃ¦ ��x Ã¤¤c ðŸ˜d Â¦bÃ Ã¸zc â€™Ãd Â¶¤x Ã¥bb ��Ã Â§Ã¶c dÃ¦¤ Ã¸¶z ðŸ˜Ã Â¤bc Ã¶xÂ§ �b"),
    ("junk", "buy now sale buy now\nbuy now sale buy now\nbuy now sale buy now\nbuy now sale buy now\nbuy now sale buy now\nbuy now sale buy now\nbuy now sale buy now\nbuy now sale buy now"),
    ("junk", "more here more more here more here more more here more here more more here more here more more here more here more more here more here more more here more here more more here more here more"),
    ("junk", "Home » news\nLog in\nAccept cookies\nShare | Print | top\nNext >>\n© 2026\nLoading... list\n[ menu ]\nLog in\nNext >>\nAccept cookies\nShare | Print | end\n© 2026\n0xpage\nLoading... more\nNext >>"),
]
CLASSES = ["prose", "list", "table", "junk"]
#: Rounds of expectation-maximisation, and the least variance of a standardised measure within a component.
ROUNDS, LEAST_VARIANCE = 12, 0.05


def _share(lines: Column, test, whole: Column) -> Column:
    return F.try_divide(F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(test(x), F.length(x)).otherwise(0)), whole)


def measure(df: DataFrame, text: str, keep: list[str], common_words: list[str]) -> DataFrame:
    """The measures of each text: `keep`, n_words, n_lines and MEASURES (null for a blank text).

    A leading line is left out where half of the text or more follows it. Shares of lines are by their characters.
    distinct_word_ratio is the mean over windows of WINDOW_WORDS words that cover the whole text.
    common_words: frequent words of the languages at hand (a bounded list).
    """
    base = spread(df.select(F.struct(*keep).alias("_keep"), F.regexp_replace(F.col(text).cast("string"), "\r\n?", "\n").alias("_t")))
    base = base.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"\S")))
    rest = F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))
    length = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    base = base.withColumn("_l", F.when((F.size("_l") > 1) & (length(rest) * 2 >= length(F.col("_l"))), rest).otherwise(F.col("_l")))
    base = base.withColumns({"_b": F.array_join("_l", "\n"), "_len": length(F.col("_l"))}).withColumn("_tok", F.filter(F.split("_b", r"\s+"), lambda x: x != ""))
    base = base.withColumn("_w", F.regexp_extract_all(F.lower("_b"), F.lit(r"(\p{L}+)"), 1))
    n, lines = F.size("_w"), F.col("_l")
    count = lambda p: F.regexp_count("_b", F.lit(p))
    of_words = lambda test: F.try_divide(F.size(F.filter("_w", test)), n)
    def is_row(x):
        t = F.trim(x)
        return (F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|"))) | F.contains(t, F.lit("\t")) | (F.contains(t, F.lit("  ")) & (F.size(F.split(t, " {2,}")) >= 3)) | x.rlike(ROW)

    # the last window ends with the text, so that all windows of a longer text have the same length
    starts = F.when(n > WINDOW_WORDS, F.transform(F.sequence(F.lit(1), n, F.lit(WINDOW_WORDS)), lambda i: F.least(i, n - WINDOW_WORDS + 1))).otherwise(F.array(F.lit(1)))
    distinct = F.aggregate("_starts", F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice("_w", i, WINDOW_WORDS))))
    base = base.withColumn("_starts", starts)
    chars = F.greatest(F.length("_b"), F.lit(1))
    m = {
        "log_words": F.log1p(F.size("_tok").cast("double")),
        "mean_word_length": F.least(F.try_divide(F.aggregate("_tok", F.lit(0), lambda a, x: a + F.length(x)), F.size("_tok")), F.lit(20.0)),
        "symbol_ratio": count(r"[^\p{L}\p{M}\p{N}\s.,;:'\"!?()|-]") / chars,
        "digit_ratio": count(r"\p{N}") / chars,
        "long_token_share": _share(F.col("_tok"), lambda x: F.length(x) > 24, chars),
        "odd_word_share": F.try_divide(F.regexp_count(F.lower("_b"), F.lit(ODD_WORD)), n),
        "common_word_share": of_words(lambda w: w.isin(common_words)),
        "punctuated_share": _share(lines, lambda x: x.rlike(r"[.!?…:][\"'”’)\]]*\s*$"), F.col("_len")),
        "bullet_share": _share(lines, lambda x: x.rlike(BULLET), F.col("_len")),
        "key_value_share": _share(lines, lambda x: x.rlike(KEY_VALUE), F.col("_len")),
        "row_share": _share(lines, is_row, F.col("_len")),
        "short_line_share": _share(lines, lambda x: F.size(F.split(F.trim(x), r"\s+")) <= LIST_ITEM_WORDS, F.col("_len")),
        "long_line_share": _share(lines, lambda x: F.size(F.split(F.trim(x), r"\s+")) > 12, F.col("_len")),
        "furniture_share": F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(FURNITURE))), F.size(lines)),
        "repeated_line_share": 1 - F.try_divide(F.size(F.array_distinct(lines)), F.size(lines)),
        "distinct_word_ratio": F.try_divide(distinct, F.size("_starts") * F.least(n, F.lit(WINDOW_WORDS))),
        "broken_char_ratio": F.when(F.length("_b") == F.octet_length("_b"), 0.0).otherwise(count("[Ã¡-¿�€™ðŸ˜ÂŸ˜]") / chars),  # plain ASCII has none
    }
    return base.select("_keep.*", n.alias("n_words"), F.size("_l").alias("n_lines"), *[F.when(F.size("_l") > 0, F.coalesce(m[k], F.lit(0.0)).cast("double")).alias(k) for k in MEASURES])


class Mixture:
    """Gaussian components with diagonal variances over standardised measures, and the class of each."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, means: np.ndarray, classes: list[str]):
        self.centre, self.scale, self.means, self.classes = centre, scale, means, classes
        self.variances = np.full_like(means, 0.5)
        self.weights = np.full(len(means), 1 / len(means))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        log = -0.5 * (((z[:, None, :] - self.means) ** 2 / self.variances) + np.log(self.variances)).sum(2) + np.log(self.weights)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Components x (weight, sums, sums of squares)."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        p = self.posterior(x)
        return np.hstack([p.sum(0)[:, None], p.T @ z, p.T @ (z * z)])

    def update(self, total: np.ndarray, anchors: np.ndarray, strength: float) -> None:
        """The M step; each component's inspected example counts as `strength` documents, so it keeps its meaning."""
        d = self.means.shape[1]
        w = total[:, :1] + strength
        mean = (total[:, 1 : d + 1] + strength * anchors) / w
        square = (total[:, d + 1 :] + strength * (anchors**2 + LEAST_VARIANCE)) / w
        self.means, self.variances = mean, np.maximum(square - mean**2, LEAST_VARIANCE)
        self.weights = (w / w.sum()).ravel()


def fit(spark: SparkSession, measures: DataFrame, common_words: list[str]) -> Mixture:
    """The mixture of all rows of `measures`. Per round one pass; only sums per component reach the driver."""
    rows = measures.select(*MEASURES).filter("log_words is not null")
    e = measure(spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(EXAMPLES)], "i int, class string, text string"), "text", ["i", "class"], common_words).orderBy("i").toPandas()
    stats = rows.agg(*[F.avg(c) for c in MEASURES], *[F.stddev_pop(c) for c in MEASURES]).first()
    x = e[MEASURES].to_numpy(float)
    k = len(MEASURES)
    centre = np.array([v if v is not None else a for v, a in zip(stats[:k], x.mean(0))], float)
    scale = np.maximum(np.array([v or 0 for v in stats[k:]], float), 0.03)
    start = np.clip((x - centre) / scale, -8, 8)
    model = Mixture(centre, scale, start.copy(), list(e["class"]))
    for _ in range(ROUNDS):
        def partial(batches: Iterator[pd.DataFrame], m: Mixture = model) -> Iterator[pd.DataFrame]:
            total = 0
            for b in batches:
                if len(b):
                    total = total + m.sums(b[MEASURES].to_numpy(float))
            if not np.isscalar(total):
                yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

        got = rows.mapInPandas(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        total = np.zeros((len(start), 2 * k + 1))
        for cell, value in got:
            total.flat[cell] = value
        old = model.means.copy()
        model.update(total, start, 3.0)
        if np.abs(model.means - old).max() < 0.01:
            break
    return model


def classify(measures: DataFrame, model: Mixture) -> DataFrame:
    """`measures` with text_class (null for a blank text) and class_probability."""
    of = np.array([[c == k for k in CLASSES] for c in model.classes], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[MEASURES].to_numpy(float)
            blank = np.isnan(x).any(1)
            p = model.posterior(np.where(blank[:, None], 0, x)) @ of
            best = p.argmax(1)
            yield b.assign(text_class=[None if n else CLASSES[i] for n, i in zip(blank, best)], class_probability=np.where(blank, np.nan, p[np.arange(len(b)), best]))

    return measures.mapInPandas(run, with_fields(measures.schema, "text_class string, class_probability double"))


def text_quality(df: DataFrame, text: str, keep: list[str], common_words: DataFrame) -> DataFrame:
    """The measures and the class of each text.

    Result: `keep`, n_words, n_lines, the measures, text_class (prose, list, table, junk), class_probability. Null and
    blank texts have neither measures nor a class; rows stay one to one; an empty input gives an empty result.
    common_words: a fixed table (lang, word).
    """
    words = sorted({r[0].lower() for r in common_words.select("word").distinct().collect()})
    measured = staged(measure(df, text, keep, words))
    return classify(measured, fit(df.sparkSession, measured, words))
