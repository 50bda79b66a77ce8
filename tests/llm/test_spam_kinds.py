"""Recall and precision of the spam judgement by kind, on texts made here with known labels."""

import random

import pytest

from tidegauge.llm.spam import spam_documents

TOPICS = "bridge ferry school library harbour pension forest grain clinic railway museum prison canal airport bus tax water road housing court".split()
PLACES = "Alderby Brackmoor Corvale Dunwick Eskford Farnley Gramsdale Holtby Inverlea Joxford Kelsham Larkwell".split()
WHO = "the minister,my honourable friend,a nurse from {p},the auditors,every parent in {p},this committee,the party opposite,a retired miner,our group,the regional council,two engineers,the previous speaker".split(",")
SAYS = "has never explained why,told us last winter that,cannot seriously believe that,wrote to me because,denied on page {n} that,asked in March whether,still insists that,found after {n} visits that,would rather not hear that,regrets today that,counted {n} days until,proved beyond doubt that".split(",")
WHAT = "the {t} budget ran dry,nobody maintains the {t},our {t} deserves better,{n} families depend on the {t},every {t} near {p} may close,the {t} contract was signed too early,promises about the {t} were broken,a {t} levy would hurt the poor,staff at the {t} are exhausted,the {t} survey contradicts itself".split(",")
TAIL = ", and that is a scandal.|; who will pay for it?|, whatever the newspapers print.| before the recess.|, as the annex shows.| in a country as rich as ours!|, Mr Speaker.| once the snow has melted.|. I thank the clerks for their work.|, so we abstain.".split("|")
GOODS = "watch handbag perfume sneaker laptop charger mattress blender vitamin casino bonus ringtone sunglass jacket carpet toaster printer scooter necklace drone".split()


def speech(r, n=14):
    def sentence():
        parts = [r.choice(WHO), " ", r.choice(SAYS), " ", r.choice(WHAT), r.choice(TAIL)]
        return "".join(parts).format(p=r.choice(PLACES), t=r.choice(TOPICS), n=r.randint(2, 999)).capitalize()

    return " ".join(sentence() for _ in range(n))


def division(r):
    names = [f"{r.choice(PLACES)[:-2]}{r.choice(['son', 'ley', 'ham', 'mann'])}, {r.choice('ABCDEFGH')}. (ab)" for _ in range(60)]
    return "Ayes: " + "; ".join(names)


def agenda(r):
    return "\n".join(f"{i}. Second reading of the {r.choice(TOPICS)} bill, {r.choice(PLACES)}" for i in range(1, 25))


def figures(r):
    return "\n".join(f"{r.choice(TOPICS)} | {r.randint(1, 999)} | {r.randint(1, 999)} | {r.randint(1, 99)} %" for _ in range(40))


def formula(r):
    return " ".join(["The question is put. The ayes have it."] * 12 + [speech(r, 12)])


def links(r):
    return "\n".join(f"{r.choice(['http://', 'https://www.', 'www.', ''])}{r.choice(GOODS)}-{r.choice(GOODS)}.{r.choice(['de', 'shop', 'io', 'co.uk', 'biz'])}/{r.choice(GOODS)}{r.randint(1, 999)}" for _ in range(30))


def stuffing(r):
    a, b = r.sample(GOODS, 2)
    return " ".join(f"Buy cheap {a} {b} online, best {a} {b} in {r.choice(PLACES)}, {a} {b} price {a} {b} offer." for _ in range(14))


def tags(r):
    return ", ".join(f"{r.choice(['cheap', 'best', 'buy', 'new', 'used'])} {r.choice(GOODS)} {r.choice(GOODS)}" for _ in range(90))


KINDS = {"speech": (speech, False), "division": (division, False), "agenda": (agenda, False), "figures": (figures, False), "formula": (formula, False), "links": (links, True), "stuffing": (stuffing, True), "tags": (tags, True)}


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(11)
    rows, kinds = [], {}
    for kind, (make, _) in KINDS.items():
        for _ in range(700 if kind == "speech" else 40):
            kinds[len(rows)] = kind
            rows.append((len(rows), make(r), "en"))
    got = {x.doc_id for x in spam_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    return {k: sum(i in got for i, x in kinds.items() if x == k) / sum(x == k for x in kinds.values()) for k in KINDS}


@pytest.mark.parametrize("kind", list(KINDS))
def test_recall_and_false_alarms_by_kind(found, kind):
    assert found[kind] >= 0.95 if KINDS[kind][1] else found[kind] <= 0.005, found
