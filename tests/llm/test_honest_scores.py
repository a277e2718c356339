"""How much the methods themselves find: secrets covered whole, and planted personal data beside look-alikes."""

import random
import string

import pytest
from rows import SCHEMA, prose, row
from secret_forms import unseen

from tidebook.llm import pii, secrets


@pytest.fixture(scope="module")
def tagger(spark, small):
    """Trained as the operator trains."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shared = secrets.trained(docs, "text", "doc_id", secrets.SAMPLE, secrets.SAMPLE_CHARS)
    return secrets.Tagger(shared.value), [r["text"] for r in docs.filter("text IS NOT NULL").orderBy("doc_id").collect()]


def test_secrets_of_unseen_forms_are_covered_whole(tagger):
    field, texts = tagger
    rng, hits, n = random.Random(177), 0, 500
    for k in range(n):
        said, value = unseen(rng)
        body = texts[k % len(texts)].split()[:60]
        body.insert(30, said)
        text = " ".join(body)
        at = text.index(value)
        spans = secrets.scan(text, field.spans([text])[0])[1]
        hits += any(s <= at and e >= at + len(value) for s, _, e in spans)
    # Eight of the nine forms are found nearly always; values between backticks hardly ever.
    assert hits / n >= 0.84, hits / n


def test_little_else_is_told_in_whole_documents(tagger):
    field, texts = tagger
    extra = 0
    for text in texts:
        base, every = secrets.scan(text, field.spans([text])[0])
        extra += any(not any(b < e and s < f for b, _, f in base) for s, k, e in every if k == 3)
    assert extra <= 0.02 * len(texts), extra


def iban(rng):
    body = "".join(rng.choice(string.digits) for _ in range(18))
    check = 98 - int(body + "131400") % 97  # D = 13, E = 14
    whole = f"DE{check:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


REAL = {
    "hidden_email": lambda r: f"{r.choice(['jane', 'bob.lee', 'k.mori', 'ana_77'])} (at) {r.choice(['corp', 'mail', 'uni-bonn'])} (dot) {r.choice(['com', 'org', 'de'])}",
    "local_phone": lambda r: f"call ({r.randrange(201, 990)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}",
    "national_id": lambda r: f"SSN {r.randrange(100, 660)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
    "iban": lambda r: f"account {iban(r)}",
    "titled_name": lambda r: f"{r.choice(['Dr.', 'Mrs.', 'Mr.', 'Prof.'])} {r.choice(['Anna', 'Maria', 'David', 'Laura'])} {r.choice(['Smith', 'Weber', 'Rossi', 'Novak'])}",
}
LIKE = {
    "hidden_email": lambda r: f"look at {r.choice(['page', 'line', 'row'])} dot {r.choice(['three', 'seven'])}",
    "local_phone": lambda r: f"order no {r.randrange(100, 199)}.{r.randrange(100, 199)}.{r.randrange(1000, 9999)}",
    "national_id": lambda r: f"part no {r.choice(['000', '666', '912'])}-{r.randrange(10, 99)}-0000",
    "iban": lambda r: f"ref {r.choice(['ZZ', 'QX'])}{r.randrange(10, 99)} " + " ".join("".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(4)) for _ in range(4)),
    "titled_name": lambda r: f"Mr. {r.choice(['Bridge', 'Window', 'Harbor'])}",
}


def test_planted_personal_data_and_look_alikes(spark):
    rng = random.Random(31)
    rows, want = [], {}
    for k in range(600):
        kind = list(REAL)[k % 5]
        real = k % 10 < 5
        said = (REAL if real else LIKE)[kind](rng)
        before = prose(k, 20)
        rows.append(row(k, f"{before} {said} {prose(k + 1, 20)}"))
        want[k] = (kind, real, len(before) + 1, len(before) + 1 + len(said))
    found = {k: [] for k in want}
    for r in pii.find_pii(spark.createDataFrame(rows, SCHEMA)).collect():
        for x in filter(None, r["spans"].split(",")):
            name, s, e = x.split(":")
            if name.startswith("weak_"):
                found[r["doc_id"]].append((name, int(s), int(e)))
    hits = sum(any(s < e2 and e > s2 for _, s, e in found[k]) for k, (_, real, s2, e2) in want.items() if real)
    wrong = sum(bool(found[k]) for k, (_, real, *_) in want.items() if not real)
    told = sum(len(found[k]) for k in found)
    reals = sum(real for _, real, *_ in want.values())
    by_kind = {name: (sum(bool(found[k]) for k, w in want.items() if w[0] == name and w[1]), sum(bool(found[k]) for k, w in want.items() if w[0] == name and not w[1])) for name in REAL}
    assert hits / reals >= 0.9, by_kind
    assert hits / max(told, 1) >= 0.8 and wrong <= 0.25 * (len(want) - reals), by_kind
