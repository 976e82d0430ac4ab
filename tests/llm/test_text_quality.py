import random
import time

import pytest

from cairnlake.llm.text_quality import NAMES, STATS, chi_square, measure, outlierness, statistics
from cairnlake.session import durable

JUNK = STATS.index("other_share")
PROSE = ["The reviewer noticed that the cache was empty after the restart, so the second run took much longer than before.\n\nIt is not clear why this happens, but the index seems to be rebuilt each time.",
         "Die Regel ist schon veraltet, weil der Vergleich seit gestern nicht mehr zum Plan passt.", "El índice falta en el informe y la regla necesita más tiempo desde ayer.",
         "> The reply was quoted in a comment\n> and wrapped over several lines, as it\n> is done in mail.", "after some digging we found that the queue was full and nobody had looked at it for a week or more",
         "# Notes\n\nWe moved the service to a new host, and it has been quiet since then.", "`load_cache` touches the cookie during the upgrade of the service.",
         " * the change quietly alters how the lock is taken while\n * another thread is holding it, and the caller still\n * expects the old order."]
OTHER = ["- split `a/b.py`\n- trim `c/d.py`\n- drop `e/f.py`", "| a | b |\n|---|---|\n| the one | in the first pass |", "a,b,count\nx,1a2b,3\ny,2c3d,4", "2025-08-11T02:14:19Z DEBUG [worker-8] patch job=c8\n2025-08-11T02:14:22Z ERROR [lease-1] x",
         "[\n {\n  \"a\": 1,\n  \"b\": true\n }\n]", "Home\nPricing\nSign in\nNext\nPrevious\nDocs", "def f(x):\n    return x + 1\n\nfor i in range(3):\n    f(i)", "====\n====\n====", "a.b = true\nc.d: on\ne.f=5\ng.h = run",
         "U/dGMhbrLGUdSobE6OPuFA5A2Fan17MH9PbaX8R8d6o\n8yPTOlkDlDCzfw1u4FRMureC8qrVzHXdCtwn9LmuBTf", "xkqzv wprtl bcdfg hjklm npqrs tvwxz qqwrt zxcvb", "The row was lost. The row was lost. The row was lost. The row was lost.",
         "* feat(a): merge the prompt (#5018) ee80b53\n* fix(b): drop the patch (#65) 877fa64", "* expand the index of the boost\n* publish the prompt of the delivery\n* match the schema of the schema\n* drop the row of the lease", "#!/bin/bash\nset -e\nif [ -f \"$X\" ]; then\n  rm -f \"$X\"\nfi"]


#: On one line each: the line looks like prose, only the distance tells.
INLINE = ["cache of the diff / scanner and the run / window of the report / cookie for the tier / row of a batch / head of the list / end of the run",
          "the rule » of the index » and a second run » the cache » to the end » of the row » in a list » the plan » for a tier » and the lock",
          "diff and the report; header in the finding; severity and the rule; scanner for the route; part of the quote; end of the run; cache of the row"]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert statistics(text)[2][JUNK] <= 0.5


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert statistics(text)[2][JUNK] > 0.5


def test_languages():
    assert [statistics(t)[0] for t in PROSE[:3]] == ["en", "de", "es"] and statistics("")[0] == "und" and statistics("12 34")[1] == 0


def test_chi_square():
    assert chi_square(0.95, 10) == pytest.approx(18.31, abs=0.05)


def test_distances(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        words = " ".join(rng.choice("the cache was empty when a second run of this index took longer and it is not clear why we saw that".split()) for _ in range(rng.randrange(20, 60)))
        lines = [words] if i % 2 else [words[:60], words[60:]]
        data.append((i, "\n".join(x.strip().capitalize() + "." * (i % 3 > 0) for x in lines if x.strip()), "xx", 1.0))
    data += [(1000 + i, t, "en", None) for i, t in enumerate(OTHER)] + [(2000, None, None, None), (2001, " \n", "en", 1.0), (2002, "the cache was empty. " * 30_000, "en", 1.0), (2000, None, None, None)]
    data += [(3000 + i, t, None, 0.0) for i, t in enumerate(INLINE)]
    half = "The cache was empty when a second run of this index took longer and it is not clear why we saw that. " * 2
    data += [(4000, half.strip() + "\n" + "- trim the `row`\n- fold the `run`\n- drop the `index`", "en", 0.0)]
    d = spark.createDataFrame(data, "doc_id bigint, text string, language string, words double")
    s = durable(measure(d))
    assert s.count() == 400 + len(OTHER) + 3 + len(INLINE) + 1
    got = {r["doc_id"]: r for r in outlierness(s).collect()}
    assert sum(got[i]["is_outlier"] for i in range(400)) < 40
    assert all(got[1000 + i]["is_outlier"] for i in range(len(OTHER)))
    # the distance decides: it finds lists whose lines pass for prose, and passes a document with some structure
    assert all(got[3000 + i]["is_outlier"] and got[3000 + i]["other_share"] < 0.5 for i in range(len(INLINE)))
    assert not got[4000]["is_outlier"] and 0.1 < got[4000]["other_share"] < 0.5
    assert got[2000]["distance"] is None and got[2000]["is_outlier"] and got[2001]["words"] == 0
    for r in got.values():
        if r["distance"] is not None:
            assert sum(r[f"c_{x}"] for x in NAMES) == pytest.approx(r["distance"], rel=1e-6, abs=1e-6)


LONG = ["a" * 10**6, "7" * 10**6, "a1" * 500_000, "key.key" * 150_000, "for in " * 150_000, "a(" * 500_000, "((" * 500_000, "a, " * 300_000, "- x\n" * 250_000, "the cache was empty. " * 50_000, "x_1-" * 250_000,
        "* a b\n" * 160_000, "= " * 500_000, "| " * 500_000, "Ã¢" * 500_000]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_linear(text):
    took = []
    for t in (text[:len(text) // 2], text):
        began = time.process_time()
        statistics(t)
        took.append(time.process_time() - began)
    assert took[1] < 3 and (took[1] < 0.3 or took[1] < 4 * took[0])


def test_scripts():
    assert [statistics(t)[0] for t in ("Кэш был пуст после перезапуска.", "Η κρυφή μνήμη ήταν άδεια.", "缓存是空的。", "キャッシュは空でした。", "캐시가 비어 있었습니다.")] == ["cyrl", "grek", "hani", "jpan", "hang"]


def test_empty(spark):
    s = measure(spark.createDataFrame([], "doc_id bigint, text string"))
    assert s.count() == 0 and outlierness(s).count() == 0
