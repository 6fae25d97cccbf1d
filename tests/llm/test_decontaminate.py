import random
import re

from fablake.llm import decontaminate as dc

from .conftest import prose

ITEM = ("The farmer Alice bought 12 kg of apples at the market, and then gave Bob half of them before she "
        "walked 3 miles home with Alice's brother Carl and counted what was left in the basket.")


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_copies_and_reparameterised_copies_are_caught_and_others_not(spark):
    again = ITEM.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carl", "Franz").replace("12 kg", "250 pounds").replace("3 miles", "7 km")
    muddled = ITEM.replace("Alice's", "Zoe's").replace("Bob", "Alice")  # one name of the item becomes two, two become one
    docs = [
        (1, ITEM), (2, prose(1, 80) + "\n" + ITEM + "\n" + prose(2, 80)), (3, prose(3, 40) + ". " + again), (4, muddled), (5, prose(4, 200)),
        (6, ITEM.lower()), (7, ITEM.replace(",", " ;").replace(".", "!")), (8, " ".join(ITEM.split()[:10])), (9, None), (10, ""),
        (11, "Name Name Name " * 60), (12, "1 2 3 4 5 6 7 8 9 " * 20), (None, ITEM), (13, (prose(5, 3000) + "\n") * 3 + ITEM),
    ]
    items = [(7, ITEM), (8, ITEM), (9, None), (10, ""), (11, "too short to count"), (None, prose(77, 30)), (12, "1 2 3 4 5 6 7 8 9 10 11 12 13")]
    out = dc.contaminated(*frames(spark, docs, items))
    assert found(out) == {(i, 7) for i in (1, 2, 3, 6, 7, 13, None)}
    assert all(list(r.item_ids) == [7, 8] for r in out.collect())
    row = next(r for r in out.collect() if r.doc_id == 3)
    assert row.matched == row.n_words and row.changed == row.slots > 0 and row.starts_at == 40


def test_every_planted_passage_is_found_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(1000 + i, rng.randint(10, 40))) for i in range(25)]
    docs = []
    for i in range(120):
        text = prose(2000 + i, rng.randint(0, 150)).split(" ")
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(items)[1].split(" ")
        docs.append((i, " ".join(text)))
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    brute = {(d, i) for d, t in docs for i, x in items if flat(x) in flat(t)}
    assert len(brute) >= 40
    assert found(dc.contaminated(*frames(spark, docs, items))) == brute


def test_more_rows_than_may_be_broadcast_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", -1)
    assert found(dc.contaminated(*frames(spark, [(1, ITEM), (2, prose(9, 90))], [(7, ITEM)]))) == {(1, 7)}


def test_odd_rows_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, prose(3, 80), "x")], "item_id long, text string, words string")
    assert found(dc.contaminated(odd, items)) == {(5, 1), (6, 1), (None, 1), (14, 1), (16, 1)}
    left = dc.clean(odd, items)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(
        str(r.doc_id) for r in odd.collect() if r.doc_id not in (5, 6, 14) and not (r.text and prose(3, 80) in r.text))
    assert dc.clean(empty, items).collect() == [] and dc.contaminated(odd, items.limit(0)).collect() == []
    assert dc.clean(odd, items.limit(0)).count() == odd.count()


def test_an_edited_item_is_found_wherever_it_starts(spark):
    item = prose(40, 15).split(" ")
    edited = item[:7] + ["elsewise"] + item[8:]
    docs = [(i, " ".join(prose(41, 40).split(" ")[:i] + edited + prose(42, 30).split(" "))) for i in range(12)]
    assert found(dc.contaminated(*frames(spark, docs, [(1, " ".join(item))]))) == {(i, 1) for i in range(12)}


def test_items_of_few_words_are_found_verbatim(spark):
    items = [(1, "Wie hoch ist der Turm?"), (2, "What is the capital of France"), (3, "Add 12 and 30"), (4, "Why"), (5, prose(43, 9)), (6, "Anna met Bob and Carl")]
    before, after = prose(44, 33), prose(45, 20)
    docs = [(i, f"{before} {t}, {after}") for i, t in items] + [
        (7, f"{before} Add 12 and 31, {after}"), (8, f"{before}. WIE hoch ist der Turm\n{after}"), (9, f"{before} Anna met Bob and Dora, {after}")]
    assert found(dc.contaminated(*frames(spark, docs, items))) == {(i, i) for i in range(1, 7)} | {(8, 1)}
    assert {r.doc_id for r in dc.clean(*frames(spark, docs, items)).collect()} == {7, 9}


def test_shifted_stretches_count_together_and_no_word_twice(spark):
    item, other = prose(50, 45).split(" "), prose(51, 7)
    spread = item[:15] + ["inserted"] + item[15:30] + ["anew"] + item[30:]
    cut = item[:15] + item[17:31] + item[33:]
    echo = f"{other} once {other} twice {prose(52, 4)}"  # 20 words, of which a document holds 7
    docs = [(1, f"{prose(53, 30)} {' '.join(spread)} {prose(54, 30)}"), (2, f"{prose(55, 31)} {' '.join(cut)} {prose(56, 30)}"),
            (3, f"{prose(57, 30)} {other} {prose(58, 30)}"), (4, " ".join(item[:15] + prose(59, 40).split(" ") + item[38:]))]
    rows = {(r.doc_id, r.item_id): r for r in dc.contaminated(*frames(spark, docs, [(1, " ".join(item)), (2, echo)])).collect()}
    assert set(rows) == {(1, 1), (2, 1)}
    assert rows[1, 1].matched == 45 and rows[2, 1].matched == 41 and rows[1, 1].starts_at == 30


def test_slots_are_held_against_each_other_inside_the_stretches_only(spark):
    quoted = prose(60, 12) + " then Anna paid 12 euros to Bert and left " + prose(61, 6)
    item = quoted + " while Anna had 12 kg of flour and Bert none at home"
    own = quoted + " whose Carl had 40 lb in Oslo but Emil saw it as well"  # slots stand where the item has others
    sums = "Add 3 and 5 to what the two boxes hold before you close both of them again"
    docs = [(1, own), (2, sums.replace("3 and 5", "4 and 4"))]
    assert found(dc.contaminated(*frames(spark, docs, [(1, item), (2, sums)]))) == {(1, 1), (2, 2)}


def test_short_items_need_more_than_half(spark):
    item = prose(62, 12).split(" ")
    docs = [(1, " ".join([prose(63, 20), *item[:6], prose(64, 20)])), (2, " ".join([prose(65, 20), *item[:10], prose(66, 20)])),
            (3, prose(67, 9) + " costs 5 kg in Rome then " + prose(68, 9))]
    items = [(1, " ".join(item)), (2, "it costs 9 kg in Bern then so")]
    assert found(dc.contaminated(*frames(spark, docs, items))) == {(2, 1)}


def test_tables_of_numbers_and_repeated_lists_end_and_copies_in_them_are_found(spark):
    rng = random.Random(8)
    numbers = [str(rng.randint(0, 9999)) for _ in range(20000)]
    pairs = " ".join(f"{x} mark" for x in numbers[:5000])
    listed = " ".join(str(rng.randint(10000, 99999)) for _ in range(40))
    summed = f"Add up these {' '.join(numbers[:60])} and then say what the sum is to the last digit of all"
    marks = " ".join(f"{rng.randint(10000, 99999)} mark" for _ in range(20))
    again = re.sub(r"\d+", lambda m: str(int(m[0]) + 1), summed)
    zeros = "0 0 0 0 0 0 0 0 0 0 0 0"
    docs = [(1, " ".join(numbers)), (2, " ".join(numbers[:9000] + [listed] + numbers[9000:])), (3, pairs), (4, " ".join([pairs, marks, pairs])),
            (5, " ".join([*numbers[:3000], summed, *numbers[3000:6000]])), (6, " ".join([*numbers[60:300], again])), (7, "0 " * 5000), (8, "0 " * 11)]
    items = [(1, listed), (2, marks), (3, summed), (4, zeros)]
    out = found(dc.contaminated(*frames(spark, docs, items)))
    assert {(2, 1), (4, 2), (5, 3), (7, 4)} <= out
    assert not {d for d, i in out if i in (1, 4)} - {2, 7} and not {d for d, i in out if i == 3} - {5, 6}
