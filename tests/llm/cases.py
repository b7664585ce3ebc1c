"""Awkward rows that every text operator must take: nulls, empty and long texts, repeats, clashing columns."""

LONG = "lorem ipsum dolor sit amet " * 4000

TEXTS = [
    (1, "Released under the MIT License.\nAll rights reserved. cc by cc BY"),
    (1, "Released under the MIT License.\nAll rights reserved. cc by cc BY"),
    (2, ""),
    (3, None),
    (None, "no id here but words"),
    (4, LONG),
    (5, "   \t\n "),
    (6, "This work is licensed under the GNU General Public License, version 3."),
    (7, "ünïcode Ärger 日本語 テキスト <|endoftext|> x<|endoftext|>"),
    (8, "Licensed under CC BY-NC 4.0. licensed under the apache license, version 2.0."),
    (9, "copyright (c) 2024 some holder name, all rights reserved"),
    (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
]


def frame(spark, rows=TEXTS):
    """Rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, 2.0, None) for i, t in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, n_words string, _uid int, score double, labels string")
