"""Every template is looked up, whatever the other notices of a file and the words of the corpus are."""

import math
import random

from cinderloom.llm import licenses


def test_all_templates_in_one_file(spark):
    notices = [t.text for t in (*licenses.BASE, *licenses.TEMPLATES)]
    common = " ".join(sorted({w for t in licenses.TEMPLATES if not t.label.startswith("mit") for w in t.text.split()} - set(licenses.TEMPLATES[1].text.split())))
    rows = [(0, " filler ".join(notices)), (1, licenses.TEMPLATES[1].text + " filler " + licenses.TEMPLATES[9].text)]
    rows += [(10 + k, common) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()}
    assert set(got[0].split(",")) == {t.label for t in (*licenses.BASE, *licenses.TEMPLATES)}
    assert got[1] == "cc-by,mit"


def labels_of(words, sides):
    """Labels by trying every start of every template; a word may stand from ``sides(slack)[0]`` to ``[1]`` beside its place."""
    found = set()
    for template in (*licenses.BASE, *licenses.TEMPLATES):
        own, base = template.text.split(), template in licenses.BASE
        slack = 0 if base else min(licenses.MOST_SLACK, len(own) // licenses.WORDS_A_SLACK)
        low, high = sides(slack)
        for start in range(-len(own), len(words)):
            same = sum(any(0 <= start + j + d < len(words) and words[start + j + d] == w for d in range(low, high + 1)) for j, w in enumerate(own))
            first = max(0, start - slack)
            near = f" {' '.join(words[first : first + len(own) + 2 * slack + licenses.AFTER])} "
            if same >= (len(own) if base else math.ceil(0.7 * len(own) - 1e-9)) and all(f" {k} " in near for k in template.keys):
                found.add(template.label)
    return found


def test_changed_notices(spark):
    """Words put in, left out and replaced, against every start tried; a few changes leave the label there."""
    rng, texts, sure = random.Random(4), [], {}
    for template in licenses.TEMPLATES:
        own = template.text.split()
        for k in range(24):
            changed = list(own)
            for _ in range(k % 6):
                at = rng.randrange(len(changed))
                kind = rng.randrange(3)
                changed[at : at + (kind > 0)] = ["odd"] if kind < 2 else []
                changed = changed or ["odd"]
            texts.append(["filler"] * rng.randrange(4) + changed + ["after"] * rng.randrange(9))
    mit = licenses.TEMPLATES[1].text
    for old, new in (("granted free", "granted and free"), ("charge to", "charge hereby to"), ("copy of", "copy"), ("deal in", "deal at will in")):
        sure[len(texts)] = "mit"
        texts.append(mit.replace(old, new).split())
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = 0
    for r in licenses.scan_licenses(docs).collect():
        got = set(filter(None, r["labels"].split(",")))
        assert labels_of(texts[r["doc_id"]], lambda s: (0, s)) <= got <= labels_of(texts[r["doc_id"]], lambda s: (-s, s)), texts[r["doc_id"]]
        kept += bool(got)
        if r["doc_id"] in sure:
            assert sure[r["doc_id"]] in got
    assert kept > len(texts) / 2
