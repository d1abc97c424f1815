"""Kinds of commands: one look at a text each, the same as by its words."""

import random
import re

from sessionloom.functions import commands as C

SPACES = " \t\n\r\v\f\x85\xa0  　"


def test_kinds_as_by_words(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = ["curl", "sudo", "npm", "install", "go", "get", "rm", "-rf", "git", "reset", "--hard", "Make Build", "TEST", "pip3", "curlx", "add", "wget", "x", "chmod -R", "go vet", ""]
    texts = ["".join(rng.choice(["", rng.choice(SPACES) * rng.randint(1, 2), " "]) + rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice(["", "\n", " "]) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for kind in (C.is_verification, C.is_destructive, C.is_network):
        assert str(kind(t)).lower().count("lower(t)") == 1  # one reading of the text
    got = df.select("t", C.is_verification(t).alias("v"), C.is_destructive(t).alias("d"), C.is_network(t).alias("n")).collect()

    def network(x):
        parts = re.sub(f"[{SPACES}]+", " ", x.lower()).strip(" ").split(" ")
        parts = parts[1:] if parts[0] == "sudo" else parts
        return parts[:1] != [] and (parts[0] in C.NETWORK_HEADS or len(parts) > 1 and parts[1] in C.INSTALLERS.get(parts[0], ()))

    for r in got:
        low = r.t.lower().strip(SPACES)
        assert (r.v, r.d, r.n) == (any(x in low for x in C.VERIFICATION), any(x in low for x in C.DESTRUCTIVE), network(r.t)), repr(r.t)
    assert sum(r.n for r in got) > 100 and sum(r.d for r in got) > 10
