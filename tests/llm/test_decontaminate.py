"""Items of the benchmark that were changed, or are too short for windows."""

import random
import re

import pytest

from parlance.llm import decontaminate
from parlance.llm.decontaminate import contaminated

ITEMS = [
    (1, "Tom has 3 red apples today. Ann eats 5 green pears daily. Bob sells 7 small plums here."),
    (2, "Solve 3x + 5 = 20"),
    (3, "2 + 2 = 4"),
    (4, "A farmer owns 12 brown cows and 15 white sheep in total"),
    (5, "The old bridge crosses a wide brown river near the small town in the far north of this land. The mayor wants it painted soon. The council said no again."),
]
DOCS = [
    (1, "Intro here. Sam has 4 red apples today. Eve eats 6 green pears daily. Max sells 9 small plums here. Bye."),
    (2, "Please solve 3x + 5 = 20 now"),
    (3, "We know 2 + 2 = 4 holds"),
    (4, "A farmer owns 10 brown cows and 10 white sheep in total"),
    (5, "They say the old bridge crosses a wide brown river near the small town in the far north of this land. A mayor wants it painted soon. This council said no again."),
    (6, "Sam has 4 red apples today. Nothing else here is like it, and 2 + 3 = 4 is wrong. Solve 3x + 5 = 21"),
    (7, "A farmer owns 10 brown cows and 10 white sheep in total, a farmer owns 12 brown"),
    (8, None),
]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_changed_and_short_items(spark, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in contaminated(docs, items, broadcast_windows=limit).collect()}
    assert set(rows) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 4)}
    assert rows[1, 1].coverage == 1 and not rows[1, 1].verbatim
    assert rows[2, 2].verbatim and rows[3, 3].verbatim and not rows[4, 4].verbatim


def searched(text, widths, number):
    """Windows of a text by plain steps: (template, values) for each width; capitals inside a sentence are names."""
    words, starts = [], True
    for raw in (text or "").split():
        word = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        if word:
            is_number = bool(re.fullmatch(r"\d[\d.,:/]*|\d[\d.,]*[^\W\d_]{1,3}", word)) or word.lower() in decontaminate.NUMBER_WORDS
            is_unit = word.lower() in decontaminate.UNITS and words and words[-1][0] == "<n>"
            is_name = word[0].isupper() and not (len(word) > 1 and word.isupper()) and not starts and not is_number
            words.append(("<n>" if is_number else "<u>" if is_unit else "<p>" if is_name else word.lower(), word.lower()))
        starts = raw[-1] in ".!?:;" if word or raw[-1] in ".!?:;" else starts
    for width in widths:
        for at in range(len(words) - width + 1):
            some = words[at : at + width]
            slots = [v for t, v in some if t.startswith("<") and t.endswith(">")]
            if 2 * len(slots) <= width:
                yield width, at, tuple(t for t, _ in some), slots


def brute(docs, items):
    """Pairs whose windows agree, with one value for each of the item's, over half of the item's windows."""
    found = {}
    for item, question in items:
        n = min(decontaminate.WIDTH, sum(1 for w in question.split() if re.search(r"[^\W_]", w)))
        own = {(at, t): slots for _, at, t, slots in searched(question, [n], None)}
        for doc, text in docs:
            aligned = {}
            for _, i, t, values in searched(text, [n], None):
                for (at, template), slots in own.items():
                    if template == t:
                        aligned.setdefault(i - at, []).append((at, tuple(zip(slots, values))))
            places = set()
            for hits in aligned.values():
                pairs = {p for _, ps in hits for p in ps}
                if len(pairs) == len({a for a, _ in pairs}):
                    places |= {at for at, _ in hits}
            if own and len(places) / len(own) >= decontaminate.COVERAGE:
                found[doc, item] = len(places)
    return found


def test_against_a_search_without_an_index(spark):
    """Sentences begin with lower case, so no word may be a name or not."""
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i)}x" for i in range(20)] + ["Ana", "Ben", "kilo", "Jahre", "mois", "días", "metros", "zwei", "trois", "cinco", "7", "3,5", "12km", "wochen"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, "also " + sentence(rng.choice([9, 14, 25]))) for i in range(25)]
    docs = []
    for k in range(120):
        words = items[k % 25][1].split()
        cut = words[rng.randrange(4) :][: rng.randrange(6, 30)]
        swap = {"7": "8", "zwei": "drei", "Ana": "Eva", "12km": "9km"} if k % 2 else {}
        changed = [swap.get(w, w) if rng.random() < 0.9 else w for w in cut]
        docs.append((k, f"before {sentence(rng.randrange(5))} then {' '.join(changed)} and {sentence(6)}"))
    want = brute(docs, items)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_windows for r in got.collect()} == want and 20 < len(want) < 110


def test_units_and_numbers_of_four_languages(spark):
    pairs = [("er lief zwei Stunden lang durch den kalten dunklen wald dort", "er lief drei Tage lang durch den kalten dunklen wald dort"), ("elle marche trois heures dans la grande forêt sombre et froide ici", "elle marche quatre jours dans la grande forêt sombre et froide ici"), ("anda cinco kilómetros por el bosque oscuro y muy frío de noche", "anda seis metros por el bosque oscuro y muy frío de noche")]
    items = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id long, text string")
    docs = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, items).collect()) == [(i, i, 1.0) for i in range(3)]
