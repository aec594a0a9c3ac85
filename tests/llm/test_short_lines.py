"""Lines of few words are copies of equal lines, and of a line with one more word from four words on."""
from routekit.llm import lines


def test_short_lines(spark):
    made = [(1, "All rights reserved.\nMenu\none two three\none two three four"), (2, "Menu\nall rights reserved.\n\none two three four five\nthree two one"), (3, "这是一行没有空格的文字\nyes yes yes yes yes no\none two"), (4, "这是一行没有空格的文字\nno yes\n \nother")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.line_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: (made[0][1], 0), 2: ("", 4), 3: (made[2][1], 0), 4: (" \nother", 2)}
