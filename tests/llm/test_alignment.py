"""Items that repeat a phrase."""
from routekit.llm import decontaminate


def test_item_with_a_repeated_phrase(spark):
    item = "In the morning Tom bought 3 red apples and then Tom bought 5 red apples before his sister ate 2 of them at home"
    far = "At noon Tom sold 3 green pears to an old friend and much later Tom sold 8 green pears to his own mother near home"
    swapped = item.replace("3", "14").replace("5", "16").replace("2", "9")
    broken = far.replace("3", "8", 1)  # both numbers of the item have one value
    made = [(1, f"Hello. {item}. Bye."), (2, f"Hello. {swapped}. Bye."), (3, f"Some more words. {far}. The end."), (4, f"Hello. {broken}. Bye."), (5, f"Hello. {item.replace('3 red', '3 blue')}. Bye.")]
    found = decontaminate.leaks(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, far)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 2)}
