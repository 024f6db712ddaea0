import random
import re
import time

import pyarrow as pa
from cases import TEXTS, docs

from auditflow.llm import decontam
from auditflow.llm import text as T

ITEM = "A train leaves Boston at 9 am and drives 120 miles to Albany. How many miles does it drive in 3 hours if Mary waits 10 minutes?"
OTHER = "A train leaves Dublin at 7 am and drives 95 km to Galway. How many km does it drive in 2 hours if Peter waits 15 minutes?"
MIXED = "A train leaves Dublin at 7 am and drives 95 km to Galway. How many kg does it drive in 2 hours if Peter waits 15 minutes?"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def items(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "item_id long, text string, size string")


def found(spark, texts, bench, **options):
    return {(r["doc_id"], r["item_id"]): (round(r["share"], 3), r["changed"]) for r in decontam.leaks(docs(spark, texts), items(spark, bench), **options).collect()}


def test_templates_as_arrays_equal_templates_word_by_word():
    random.seed(8)
    signs = "abAB é É ñ 19.,:!?\"'()#*$% \n\t km × ÷ ß “x” 世"
    texts = ["".join(random.choices(signs, k=60)) for _ in range(3000)] + [t for t in TEXTS if t] + [ITEM, OTHER, "It cost 5 $ . 5 km, 7KM! 12:30 h (3 m)", "NAME Name name. Name\nName É. Été x Été"]
    codes, slots, first = decontam.template_words(pa.array(texts))
    for k, text in enumerate(texts):
        want = decontam.tokens(text)
        a, b = first[k], first[k + 1]
        assert codes[a:b].tolist() == [decontam._hash(t) for t, _ in want], text
        assert slots[a:b].tolist() == [decontam._hash(s) | 1 if s else 0 for _, s in want], text


def test_other_numbers_names_and_units(spark):
    got = found(spark, [f"Intro. {ITEM} Outro.", OTHER, "nothing of the kind here at all"], [ITEM])
    assert got == {(0, 0): (1.0, False), (1, 0): (1.0, True)}


def test_slots_must_be_consistent(spark):
    # One value of the item cannot stand for two: miles became km, then kg.
    assert found(spark, [ITEM, OTHER, MIXED], [ITEM]) == {(0, 0): (1.0, False), (1, 0): (1.0, True)}


def test_passage_inside_other_text_and_edited(spark):
    random.seed(9)
    item = " ".join(random.choices(WORDS, k=60))
    noise = " ".join(random.choices([w[::-1] for w in WORDS], k=300))
    edited = item.split()
    edited.insert(30, "extra")
    half = " ".join(item.split()[:30])
    got = found(spark, [f"{noise} {item} {noise}", f"{noise}\n{' '.join(edited)}. {noise}", f"{noise} {half} {noise}", noise], [item])
    assert set(got) == {(0, 0), (1, 0)} and got[0, 0] == (1.0, False) and got[1, 0][0] >= 0.9


def test_words_put_in_at_the_middle(spark):
    random.seed(10)
    item = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    noise = [f"z{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    texts = [" ".join(noise[:shift] + item[:30] + noise[-n:] + item[30:]) for n in (1, 5, 6, 7, 10, 25) for shift in range(8)]
    got = found(spark, texts, [" ".join(item)])
    assert got == {(k, 0): (round(52 / 56, 3), False) for k in range(len(texts))}


def test_parts_out_of_order_or_far_apart_are_no_passage(spark):
    item = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    noise = [f"z{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    assert found(spark, [" ".join(item[30:] + item[:30]), " ".join(item[:30] + noise + item[30:])], [" ".join(item)]) == {}


PENS = "Sam sells 3 pens to each child of the large school and then rests for 3 days under the old tree"


def test_one_conflicting_slot_takes_its_own_windows_only(spark):
    one = PENS.replace("3 days", "4 days")
    both = PENS.replace("3 pens", "4 pens").replace("3 days", "5 days")
    assert found(spark, [one, both], [PENS]) == {(0, 0): (1.0, True), (1, 0): (1.0, True)}
    # A unit that became two others costs the windows of the rarer one; the rest is enough in a long item.
    long = f"{ITEM} {' '.join(WORDS)}"
    mixed = f"{MIXED} {' '.join(WORDS)}"
    assert found(spark, [mixed], [long]) == {(0, 0): (round(1 - 5 / 43, 3), True)}


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    other = OTHER.replace("95", "96").replace("7 am", "6 am").replace("Dublin", "Cork")
    got = decontam.leaks(docs(spark, [OTHER, other, "clean text"], [7, 7, 7]), items(spark, [ITEM])).collect()
    assert [(r["doc_id"], r["item_id"], r["share"], r["changed"]) for r in got] == [(7, 0, 1.0, True)]
    twice = spark.createDataFrame([(1, ITEM), (1, PENS)], "item_id long, text string")
    assert decontam.leaks(docs(spark, [PENS]), twice).count() == 1


def test_copies_with_other_numbers_one_after_the_other(spark):
    first, second = OTHER.replace("km", "ft"), OTHER.replace("Peter", "Paul").replace("Dublin", "Cork")
    cut, words = first.split(), second.split()
    assert found(spark, [f"{OTHER} {first} {second}", " ".join(cut[:-3] + words[3:])], [ITEM])[0, 0] == (1.0, True)
    verbatim = found(spark, [f"{OTHER} {ITEM}"], [ITEM])
    assert verbatim == {(0, 0): (1.0, False)}


def test_names_that_open_sentences_and_names_of_other_lengths(spark):
    story = ("Tom buys {a} red apples at the market near the old bridge. {n} eats two of them on the way home. "
             "{m} gives {b} of the others to a friend from {c} who likes them a lot. How many red apples are left?")
    item = story.format(a=9, b=3, n="Tom", m="Tom", c="Boston")
    texts = [story.replace("Tom", "Ann").format(a=8, b=2, n="Ann", m="Ann", c="New York"),
             story.replace("Tom", "Mary Ann").format(a=8, b=2, n="Mary Ann", m="Mary Ann", c="Los Angeles"),
             "As we know " + story.format(a=9, b=3, n="Tom", m="Tom", c="Boston")]
    got = found(spark, texts, [item])
    assert got == {(0, 0): (1.0, True), (1, 0): (1.0, True), (2, 0): (1.0, False)}
    assert set(found(spark, [item, texts[0]], [texts[1]])) == {(0, 0), (1, 0)}


def test_both_readings_of_short_texts():
    for text, other, tied in (("Mary Ann buys", [0], [1]), ("So. Tom buys. Ann", [0, 1, 3], []), ("I am. É", [], []), ("So Éa. Été Łódź x", [0, 2], [1, 3])):
        got = decontam.readings(pa.array([text]))
        assert got.other.tolist() == other and [k for k, t in enumerate(got.tied) if t] == tied, text


def test_clean_documents_stay(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(table, bench).collect()}
    want = set()
    questions = [(r["item_id"], [t for t, _ in decontam.tokens(r["text"])]) for r in bench.collect()]
    grams = {}
    for item, words in questions:
        for k in range(len(words) - 4):
            grams.setdefault(tuple(words[k : k + 5]), set()).add((item, k))
    size = {item: len(words) - 4 for item, words in questions}
    for r in table.collect():
        words, hits = [t for t, _ in decontam.tokens(r["text"])], {}
        for k in range(len(words) - 4):
            for item, place in grams.get(tuple(words[k : k + 5]), ()):
                hits.setdefault(item, set()).add(place)
        want |= {(r["doc_id"], item) for item, places in hits.items() if len(places) >= 0.8 * size[item]}
        # Windows with the first word of a passage may read it as a name.
        want |= {(r["doc_id"], item) for item, places in hits.items() if len(places | {0}) >= 0.8 * size[item] and len(places) >= 0.7 * size[item]}
    assert got and got <= want and {d for d, _ in want} == {d for d, _ in got}


def test_cases(spark):
    bench = [None, "", "too few words", ITEM, ITEM]
    got = found(spark, [*TEXTS, ITEM, ITEM], bench)
    n = len(TEXTS)
    assert set(got) == {(n, 3), (n, 4), (n + 1, 3), (n + 1, 4)}
    assert found(spark, [], bench) == {} and found(spark, TEXTS, []) == {}
    twice = decontam.leaks(docs(spark, [ITEM, ITEM, ITEM], [7, 7, None]), items(spark, [ITEM])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in twice] == [(7, 0)]
    table = docs(spark, [ITEM, "clean text", None], [1, 2, None])
    kept = decontam.clean(table, items(spark, [ITEM]))
    assert kept.columns == table.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]


def test_rows_are_cleaned_one_by_one(spark):
    table = docs(spark, [ITEM, "clean text of its own", ITEM, "clean text without an id", None], [1, 1, None, None, None])
    kept = decontam.clean(table, items(spark, [ITEM]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [
        (1, "clean text of its own"), (None, "clean text without an id"), (None, None)]


def test_map_of_bits(spark):
    windows = spark.createDataFrame([(g,) for g in (0, -1, 5 << 40, 1 << 62)], "gram long")
    bits = decontam.bit_map(windows)
    assert sum(int(b).bit_count() for b in bits) == 4
    assert len(bits) == 1 << (decontam.MAP_BITS - 3) and T.BLANK.sum() == 6


def test_long_lists_of_numbers_meet_few_windows(spark):
    draw = random.Random(5)
    bench = [" ".join(draw.sample(WORDS, 8) + [str(draw.randrange(999)) for _ in range(8)] + draw.sample(WORDS, 8)) for _ in range(200)]
    other = [re.sub(r"\d+", lambda m: str(int(m[0]) + 1000), t) for t in bench[:3]]
    long = " ".join(str(draw.randrange(10_000)) for _ in range(1_000_000))
    start = time.time()
    got = found(spark, [long, f"{long[:500]} {bench[7]} {long}", *other, bench[9]], bench)
    assert time.time() - start < 60
    assert got == {(1, 7): (1.0, False), (2, 0): (1.0, True), (3, 1): (1.0, True), (4, 2): (1.0, True), (5, 9): (1.0, False)}


def test_items_of_numbers_alone_are_found_word_for_word(spark):
    numbers = "12 45 7 81 33 90 4"
    assert found(spark, [f"some words {numbers} more words", "12 45 7 81 34 91 5", "9 1 45 7 2 3 8 1 1"], [numbers]) == {(0, 0): (1.0, False)}


def test_runs_at_the_edges_of_an_item(spark):
    item = "3 4 5 6 7 8 pens were sold to the first shop in town and then 1 2 3 4 5 6"
    text = "13 14 15 16 17 18 pens were sold to the first shop in town and then 21 22 23 24 25 26"
    assert found(spark, [f"99 98 97 {text} 77 76", f"words {text} words"], [item]) == {(0, 0): (1.0, True), (1, 0): (1.0, True)}
