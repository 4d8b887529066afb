import hashlib
import random
import re
import zlib

import pytest

from siltworks.llm.repair import DUPLICATE, NOTHING, ORACLE_SQL, PAIRS, SOUND, TRUNCATED, compose, conversation_digests, edits, parse, repair_conversations, repair_report
from tests.oracle import duck, same_rows

INITIALS = {"user": "u", "assistant": "a", "system": "s"}


def cheapest(cells):
    """The least (cost, audit) by trying all audits in the order of cost, one edit at a time, without a chart."""
    tokens = [(i, fault if k == 0 else DUPLICATE) for i, fault, copies in cells for k in range(copies)]
    best = [(0, "", 0, "")]  # cost, audit, tokens read, roles
    found = None
    limit = 3 * len(tokens)
    while best:
        new = []
        for cost, audit, at, roles in best:
            if cost > limit or (found and cost > found[0]):
                continue
            if at == len(tokens) and re.fullmatch("(s?(ua)+)?", roles) and (found is None or (cost, audit) < found):
                found = (cost, audit)
            if re.fullmatch("s?(ua)*u?", roles) is None:
                continue
            new += [(cost + 2, audit + "I", at, roles + r) for r in "ua"]
            if at < len(tokens):
                initial, fault = tokens[at]
                new.append((cost + 3, audit + "D", at + 1, roles))
                if fault < DUPLICATE:
                    cut = fault == TRUNCATED
                    new.append((cost + cut, audit + "K", at + 1, roles + initial))
                    new += [(cost + cut + 2, audit + "R", at + 1, roles + r) for r in "ua"]
        best = [b for b in new if re.fullmatch("s?(ua)*u?", b[3]) or b[3] == ""]
    return found


def dynamic(tokens):
    """The same by a table over turns and roles so far, for longer conversations: (initial, fault) of each turn."""
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def close(row):
        for _ in range(4):
            for state, (cost, audit) in list(row.items()):
                for role, to in states[state].items():
                    if role != "s":
                        row[to] = min(row.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return row

    row = close({"": (0, "")})
    for initial, fault in tokens:
        new = {}
        for state, (cost, audit) in row.items():
            options = [(state, cost + 3, audit + "D")]
            if fault < DUPLICATE:
                cut = fault == TRUNCATED
                options += [(to, cost + cut + (0 if kind == "K" else 2), audit + kind) for role, to in states[state].items() for kind in "KR" if (kind == "K" and role == initial) or (kind == "R" and role != "s")]
            for to, c, a in options:
                new[to] = min(new.get(to, (10**9, "")), (c, a))
        row = close(new)
    return min(row[s] for s in ("", "a") if s in row)


def some_cells(rng, n, roles="usat"):
    return [(rng.choice(roles), rng.randrange(4), rng.choice([1, 1, 1, 2])) for _ in range(n)]


def tokens_of(cells):
    return [(i, fault if k == 0 else DUPLICATE) for i, fault, copies in cells for k in range(copies)]


def best_of(column):
    return min(column[s] for s in (NOTHING, PAIRS) if s in column)


def test_parse_against_all_audits():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        for _ in range(6):
            cells = [(i, f, 1) for i, f, _ in some_cells(rng, n)]
            assert best_of(parse(cells)) == cheapest(cells)
            assert dynamic(tokens_of(cells)) == cheapest(cells)


def test_parse_against_a_table():
    rng = random.Random(2)
    for _ in range(400):
        cells = some_cells(rng, rng.randrange(25), rng.choice(["ua", "usa", "usatx", "a"]))
        assert best_of(parse(cells)) == dynamic(tokens_of(cells))


def test_pieces_compose_to_the_whole():
    rng = random.Random(3)
    for _ in range(200):
        cells = some_cells(rng, rng.randrange(1, 30), rng.choice(["ua", "usa", "usatx", "a", "s"]))
        cuts = sorted(rng.sample(range(1, len(cells)), rng.randrange(min(len(cells), 6)))) if len(cells) > 1 else []
        parts = [cells[a:b] for a, b in zip([0, *cuts], [*cuts, len(cells)])]
        items = [[{"start": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in parse(p, s).items()] for p in parts]
        cost, chosen = compose(items)
        assert (cost, "".join(a for _, a in chosen)) == best_of(parse(cells))
        done, roles = [], ""
        for p, (state, audit) in zip(parts, chosen):
            out, tail = edits(audit, p, state)
            done += out
            roles += "".join(lead + (becomes or c[0] if edit != "D" else "") for c, (lead, edit, becomes) in zip(p, out)) + tail
        assert re.fullmatch("(s?(ua)+)?", roles)


def expected(rows, ids):
    """The report by its words, of (conv_id, turn, role, text) rows."""
    groups = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    out = []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        kinds = {"": SOUND, "truncated": TRUNCATED}
        cost, audit = dynamic([(role[:1], kinds.get(f, DUPLICATE)) for (_, role, _), f in zip(turns, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        lines, at, state = [], iter(turns), ""
        for letter in audit:
            expect = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(f"{expect}:")
                state = expect[0]
                continue
            _, role, text = next(at)
            if letter != "D":
                role = role if letter == "K" else expect
                lines.append(f"{role}:{text}")
                state = role[0]
        out.append((conv, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else v
        case = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def made(rng, conversations, longest):
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else rng.choice([t, t, t, t + 1, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "and then", "", " \t\n", None, f"text {t}?", "wait.  \x0b", "é. "])
            rows.append((rng.choice([c, c, c, c, c, c, c, None]), turn, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def report_rows(df):
    assert df.columns == list(COLUMNS)
    return sorted(map(tuple, df.collect()), key=str)


def test_report_on_made_conversations(spark):
    rows = made(random.Random(4), 150, 14)
    out = repair_report(spark.createDataFrame(rows, SCHEMA))
    assert report_rows(out) == expected(damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_conversations_in_pieces(spark, piece):
    """A conversation in many pieces and on several tasks gives what it gives in one."""
    rng = random.Random(piece)
    rows = [(c, rng.randrange(40), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"text {t}."])) for c in range(3) for t in range(90)]
    turns, report = repair_conversations(spark.createDataFrame(rows, SCHEMA), piece=piece)
    out = report.join(conversation_digests(turns), "conv_id", "left").select(*COLUMNS)
    assert report_rows(out) == expected(rows, {0, 1, 2})


def test_report_of_the_table(spark, small):
    conversations = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert report_rows(repair_report(conversations)) == expected(damage(rows), {r[0] for r in rows})


def test_same_as_sql(spark, small):
    same_rows(repair_report(spark.read.parquet(f"{small}/conversations.parquet")), duck(small), ORACLE_SQL)


def test_turns_of_a_repair(spark):
    rows = [(1, 5, "assistant", "Hello."), (1, 1, "system", "Be good."), (1, 7, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, None, "tool", "  "), (2, 1, "tool", "x.")]
    turns, report = repair_conversations(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", piece string, place int"))
    lines = [tuple(r)[:1] + tuple(r)[2:] for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.place))]
    assert lines == [(1, "K", "system", "Be good."), (1, "K", "user", "Hi."), (1, "K", "assistant", "Hello.")]
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (6, "DKKKD"), 2: (3, "D")}


def test_odd_tables(spark):
    assert repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "a sentence. " * 100_000
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (None, None, None, None), (None, None, None, None)]
    assert report_rows(repair_report(spark.createDataFrame(rows, SCHEMA))) == expected(damage(rows), {1, None})


def test_a_hot_conversation_of_equal_rows(spark):
    """Thousands of equal rows are one row with a count before anything is sorted."""
    rows = [(1, 3, "user", "Yes.")] * 4000 + [(c, 1, "user", "Yes.") for c in range(2, 1000)]
    turns, report = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    found = {r.conv_id: r for r in report.collect()}
    # One user's turn kept and an assistant's inserted cost less than taking it out.
    assert (found[1].cost, found[1].audit, found[1].duplicate, found[1].illegal) == (2 + 3 * 3999, "K" + "D" * 3999 + "I", 3999, 3999)
    assert found[5].audit == "KI" and turns.count() == 2 * 999
