"""Conversation repair, passage removal and spelling variants beside plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest

from evenreel.llm import doubling, repair, variants

WORD = re.compile("[^\x20\x09-\x0d]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- repair ------------------------------------------------------------------------
def order(row):
    return (row[1] is not None, row[1] or 0, row[2].encode(), row[3].encode())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        hit = zlib.crc32(":".join(shown).encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=order)


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        spoken = WORD.findall(text)
        out.append("blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, found, inserts=2):
    """Cheapest (cost, audit, repaired) of all edits with at most ``inserts`` insertions in a gap."""
    best = None
    gaps = [[x for n in range(inserts + 1) for x in product("ua", repeat=n)]] * (len(rows) + 1)

    def walk(i, cost, audit, said):
        nonlocal best
        for gap in gaps[i]:
            cost2, audit2 = cost + 5 * len(gap), audit + "I" * len(gap)
            said2 = said + [({"u": "user", "a": "assistant"}[g], "") for g in gap]
            if best and cost2 > best[0]:
                continue
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said2)):
                    best = min(best or (cost2, audit2, said2), (cost2, audit2, said2))
                continue
            _, _, role, text = rows[i]
            walk(i + 1, cost2 + 2, audit2 + "D", said2)
            if found[i] in ("", "truncated"):
                more = 5 * (found[i] == "truncated")
                walk(i + 1, cost2 + more, audit2 + "K", [*said2, (role, text)])
                for new in ("user", "assistant"):
                    walk(i + 1, cost2 + more + 1, audit2 + "R", [*said2, (new, text)])

    walk(0, 0, "", [])
    return best


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv])
        found = faults(mine)
        cost, audit, said = every_repair(mine, found, 1 if len(mine) < 5 else 0)
        turns = {r[1] for r in mine} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest("\n".join(f"{r}:{t}" for r, t in said)),
        )
    return out


SAID = "conv_id long, turn long, role string, text string, _conv int, `a.b` int"


def repaired(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SAID)
    out = repair.repair_damaged(frame)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def test_repair_is_the_cheapest_of_all(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Hello.", "So it is!", "And then", "", "  \n", None, "Why? ", f"Turn {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (None, None, "user", "C."), rows[0], rows[0]]
    assert repaired(spark, rows) == plain_repair(rows)


def test_repair_of_long_and_empty_conversations(spark, monkeypatch):
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "user", "system"]
    rows = [(7, t, rng.choice(roles), f"Sentence {t}{rng.choice(['.', '!', ''])}") for t in range(900)]
    whole = repaired(spark, rows)
    monkeypatch.setattr(repair, "STRETCH", 50)
    assert repaired(spark, rows) == whole  # however the rows are cut
    mine = damage(rows)
    assert whole[7][6].count("D") + whole[7][6].count("K") + whole[7][6].count("R") == len(mine)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "x" * 100_000)]) == {gone: (0, 0, 0, 0, 0, 0, "", digest(""))}
    assert repaired(spark, []) == {}


def test_cut_conversations_compare_like_whole_ones():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("uuaasx"), rng.choice(["", "", "", "blank", "truncated"])) for _ in range(rng.randint(1, 12))]
        w = repair.Weights(3 * len(rows) + 2)
        path = repair.cheapest(rows, {s: 0 for s in repair.ENDS}, w)[repair.START]
        cuts = sorted({0, *(rng.randrange(len(rows)) for _ in range(3)), len(rows)})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        tables = [repair.stretch_table(p, k == 0, k == len(parts) - 1) for k, p in enumerate(parts)]
        assert "".join(x for _, x in repair.put_together(tables)) == w.letters(path)
        fits = [[(None, None, {"u": "user", "a": "assistant", "s": "system", "x": "x"}[i], "t") for i, _ in rows], [f for _, f in rows]]
        if len(rows) <= 5:
            cost, audit, _ = every_repair(*fits)
            assert (w.cost(path), w.letters(path)) == (cost, audit)


# -- passages ----------------------------------------------------------------------
def plain_passages(rows, length):
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (doc, _), ws in zip(rows, words, strict=True):
        for i in range(len(ws) - length + 1):
            if doc is not None:
                key = tuple(ws[i : i + length])
                least[key] = min(doc, least.get(key, doc))
    out = []
    for (doc, _), ws in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(ws) - length + 1):
            low = least.get(tuple(ws[i : i + length]))
            if low is not None and (doc is None or low < doc):
                gone.update(range(i, i + length))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((doc, len(ws), len(ws) - len(kept), digest(" ".join(kept)), len(kept), " ".join(kept)))
    return Counter(out)


def passages(spark, rows, length=50):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, body string, `a.b` int")
    out = doubling.drop_passages(frame, length=length, keep_text=True)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "n_kept", "kept"]
    return Counter(tuple(r) for r in out.collect())


def test_level_lengths():
    assert doubling.levels(50) == [13, 25, 50] and doubling.levels(10) == [5, 10] and doubling.levels(33) == [9, 17, 33]


@pytest.mark.parametrize("length", [50, 20, 8])
def test_passages_match_plain_python(spark, length):
    rng = random.Random(length)
    source = [rng.choice("alpha beta gamma delta é ß".split()) + str(rng.randrange(40)) for _ in range(2000)]
    rows = [(None, None), (3, ""), (4, "one"), (5, " \t\n")]
    for doc in range(120):
        words = []
        for _ in range(rng.randint(1, 5)):
            at, n = rng.randrange(1900), rng.randint(1, 3 * length)
            words += source[at : at + n]
            words += [f"own{doc}{i}" for i in range(rng.randint(0, 12))]
        rows.append((rng.choice([doc, doc, doc, None, doc // 2]), rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += rows[-3:] + [(1000, " ".join(["same"] * 300)), (900, " ".join(["same"] * 200)), (901, " ".join(["same"] * 200))]
    assert passages(spark, rows, length) == plain_passages(rows, length)


def test_long_texts_are_cut_without_effect(spark, monkeypatch):
    monkeypatch.setattr(doubling, "SWEEP", 512)
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:5500])), (3, " ".join(words[700:760])), (4, "x" * 200_000)]
    bodies = [doubling.Words(t.encode()) for _, t in rows]
    assert max(b - a for pieces in doubling._sweeps(bodies, 50) for _, a, b in pieces) == 512 + 49
    assert passages(spark, rows) == plain_passages(rows, 50)


def test_passages_of_an_empty_table(spark):
    assert passages(spark, []) == Counter()


# -- variants ----------------------------------------------------------------------
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    others = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and abs(len(a) - len(b)) < 2 and near(a, b):
                others[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(others[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return Counter((w, form[w], root(w), n, len(others[w]), words.get(form[w])) for w, n in words.items())


def spelt(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, word string, `a.b` int")
    out = variants.spelling_variants(frame)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return Counter(tuple(r) for r in out.collect())


def test_variants_match_plain_python(spark):
    rng = random.Random(2)
    stems = ["color", "house", "écoute", "aabbaa", "aaaaa", "hello", "straße", "ÀÉîõü", "naïve"]
    pool = []
    for stem in stems:
        for _ in range(25):
            at = rng.randrange(len(stem) + 1)
            pool += [stem, stem[:at] + rng.choice("abéz×") + stem[at:], stem[: at - 1] + stem[at:], stem[:at] + rng.choice("oaÿ") + stem[at + 1 :]]
    rows = [(None, None), (0, ""), (1, "ab Ab 12 _ ÿ÷")]
    for doc in range(200):
        rows.append((rng.choice([doc, doc, None]), " ".join(rng.choice([w, w.upper()]) for w in rng.choices(pool, k=60))))
    rows += rows[-2:] + [(7, "b" * 5000 + " " + "b" * 4999 + " ")] * 4
    got, want = spelt(spark, rows), plain_variants(rows)
    assert got == want
    assert any(form and root != form for _, form, root, *_ in want)  # chains of two


def test_variants_of_an_empty_table(spark):
    assert spelt(spark, []) == Counter()
