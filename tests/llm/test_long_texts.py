"""Very long and odd texts for the operators on secrets, chats and personal data."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clearwell.llm import chat_format, secret_scan, surrogates
from clearwell.llm.queries import SQL

N = 100_000


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(surrogates.replace_entities(df, "key").collect(), key=lambda r: r.doc_id)]


def test_every_loop_runs_a_hundred_thousand_times(spark):
    texts = ["Mr " + "Abc " * N, "x@a" + ".b" * N, "Dr " + "A." * N + " Smith", "Dr " * N + "Weber", "Dr " * N + "x", "Mr " + "de " * N + "Ruyter",
             "Mr A " + "B " * N + "Smith", "Mr Anna " + "J. " * N, "Mr A." + "-B." * N + " Smith", "a" * N + "@", "1." * N, "+1" + "-12" * N, "AB12" + " ABCD" * N]
    got = replaced(spark, texts)
    assert [r.n_entities for r in got[:9]] == [1, 1, 1, 1, 0, 1, 1, 1, 1]
    assert got[4].text == texts[4] and got[9].text == texts[9]
    for i, left in ((0, "Abc"), (2, "Smith"), (3, "Weber"), (5, "Ruyter"), (6, "Smith"), (7, "Anna"), (8, "Smith")):
        assert left not in got[i].text


def test_names_mentioned_again(spark):
    texts = ["Mrs Anna Schmidt came. Schmidt left, Anna stayed; Schmidt's dog, SCHMIDT and Annabel too.", "Schmidt alone is no name.",
             "Mr Paul O'Brien and Dr Schmidt: O'Brien, O'Brien’s, Schmidt-Weber."]
    got = [r.text for r in replaced(spark, texts)]
    first, last = re.match(r"Mrs (\w+) (\w+) came", got[0]).groups()
    assert got[0] == f"Mrs {first} {last} came. {last} left, {first} stayed; {last}'s dog, SCHMIDT and Annabel too."
    assert got[1] == texts[1]
    brien = re.match(r"Mr \w+ (\S+) and Dr (\w+):", got[2]).groups()
    assert brien[1] == last and got[2].endswith(f": {brien[0]}, {brien[0]}’s, Schmidt-Weber.")


def test_surrogates_equal_a_plain_walk(spark):
    """Random texts: entities of a plain search by the same patterns, each told from the next, the same ones alike everywhere."""
    rng = random.Random(4)
    people = ["Mr Karl Weber", "Frau Dr. Lena Huber", "Mme Zoé d'Arc", "Dr J. R. Kim", "Mrs Ada Byron King"]
    parts = people + ["kim@x.org", "a.b+c@d-e.co.uk", "555-123-4567", "(555) 123-4567", "+49 89 1234 5678", "10.1.2.3", "4111 1111 1111 1111", "the cat", "12.5", "no one", "Weber", "x"]
    texts = [" ; ".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(80)]
    got = replaced(spark, texts)
    same: dict[str, set] = {}
    for text, r in zip(texts, got):
        old, new = text.split(" ; "), r.text.split(" ; ")
        assert len(old) == len(new)
        entities = [p for p in old if re.search(r"@|^\+?\(?\d[\d ()-]{6,}|^10\.|^(Mr|Mrs|Frau|Mme|Dr) ", p)]
        assert r.n_entities == len(entities)
        for a, b in zip(old, new):
            if a in entities:
                same.setdefault(a, set()).add(b)
                assert a != b
            elif a != "Weber":
                assert a == b
            else:
                assert (b != a) == ("Mr Karl Weber" in old)
    assert all(len(s) == 1 for s in same.values()) and len({min(s) for s in same.values()}) == len(same)


def test_turns_of_thirty_million_characters(spark):
    piece, times = 'x"[INST]é\\', 3_000_000
    big = F.repeat(F.lit(piece), F.lit(times))
    turns = [(1, 0, "user", F.lit("hi")), (1, 1, "assistant", big), (2, 0, "user", big), (2, 1, "user", F.lit("b")), (2, 2, "assistant", F.lit("c"))]
    rows = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), x.alias("text")) for c, t, r, x in turns))).alias("r")).select("r.*")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_turns(chat_format.canonical_turns(chat_format.conversation_records(rows)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(piece) * times, sha(piece * times))
    assert got[1].turns_sha256 == sha(f"user\nhi\nassistant\n{piece * times}\n")
    assert (got[2].n_turns, got[2].loss_chars) == (3, 1) and got[2].turns_sha256 == sha(f"user\n{piece * times}\nuser\nb\nassistant\nc\n")


@pytest.mark.parametrize("record", [
    '{"prompt": "a \\" : \\\\", "completion": "b"}', '{"messages": [{"role": "user", "content": "x\\n"}, {"role": "a", "content": ""}]}',
    '{"a": ["x", "y: \\"z\\"", {"b": "c"}], "d": 1, "e": null, "f": "", "": "g"}', '{"k\\"ey" : "v", "k2":"w"}', "[]", "no json"])
def test_fingerprint_without_strings(spark, record):
    """Emptied strings leave the same field paths."""
    row = spark.createDataFrame([(record,)], "record string").select(
        chat_format.fingerprint(F.col("record")).alias("whole"), chat_format.fingerprint(chat_format._without_strings(F.col("record"))).alias("bare")).first()
    assert row.whole == row.bare


def test_secrets_equal_their_sql(spark):
    """Keys, whole and torn, in all line endings, against the query's SQL."""
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("ABCabc012+/=") for _ in range(rng.choice([3, 15, 16, 40])))
    brk = ["\n", "\r\n", "\\n", "\n\n", " ", " \n\t", "\\r\\n"]

    def key():
        name = rng.choice(["PRIVATE KEY", "RSA PRIVATE KEY", "PGP PRIVATE KEY BLOCK", "PUBLIC KEY"])
        head = rng.choice(["", f"{rng.choice(brk)}Proc-Type: 4,ENC", f"{rng.choice(brk)}Comment: x y"])
        body = "".join(rng.choice(brk) + line() for _ in range(rng.randrange(5)))
        return f"-----BEGIN {name}-----{head}{body}{rng.choice(['', rng.choice(brk)])}{rng.choice(['', f'-----END {name}-----', '-----END', chr(34)])}"

    other = ["token = 'abcdef12'", "http://u:pw1@host/", "a://:b@", "x+y://u%4:p@@", "AKIA" + "Q7" * 9, "deadbeef" * 4, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "плохо", "Bearer " + "a" * 30, "\n", '"']
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice([key(), *other]) for _ in range(rng.randrange(6))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, ""), (-3, texts[0]), (-4, "é" * N + " token=abcdef12 " + "a" * N)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x"))
    got = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans) for r in secret_scan.scan_secrets(df).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.execute(SQL["op8_trigram_secrets"]).fetch_df()
    assert got == dict(zip(want.doc_id, want.spans))
    assert sum("private_key" in s for s in got.values()) > 50


def test_rule_that_only_re_knows(spark):
    rule = secret_scan.Rule("odd", r"(?<!\d)\d{3}(?!\d)")
    df = spark.createDataFrame([(1, "123 4567 89 012"), (1, "123 4567 89 012"), (2, None)], "doc_id long, text string")
    assert secret_scan.rule_query(rule) is None
    got = sorted((r.doc_id, [(s.start, s.end) for s in r.spans]) for r in secret_scan.scan_secrets(df, (rule,)).collect())
    assert got == [(1, [(0, 3), (12, 15)]), (1, [(0, 3), (12, 15)]), (2, [])]
