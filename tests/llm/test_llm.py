import os
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from fixloom.llm import canonical, components, consensus, leakage, overlap, packing, representative, spam, splits
from fixloom.llm import queries as llm

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FULL, OTHER = "0123456789abcdef0123456789abcdef01234567", "f" * 40
P, Q = "https://f.example/a/b", "https://f.example/c/d"
ENTRY = "entry_id long, project_url string, commit_id string, src_datasets array<string>, is_vfc boolean, cve_ids array<string>, function_name string, split string, ingested_at timestamp, commit struct<message string, diff string, files_changed array<string>, authored_at timestamp, committed_at timestamp>, _id string, _f string, text string"
NOTHING = (None, None, [], None, None)


def entries(spark, *rows):
    base = {"entry_id": None, "project_url": P, "commit_id": FULL, "src_datasets": ["s"], "is_vfc": True, "cve_ids": [], "function_name": None, "split": "train", "ingested_at": None, "commit": NOTHING, "_id": "x", "_f": "x", "text": "x"}
    return spark.createDataFrame([tuple((base | {"entry_id": i + 1} | r).values()) for i, r in enumerate(rows)], ENTRY)


def catalogue(spark):
    return spark.createDataFrame([("s", 2), ("t", 1), ("u", None)], "src_dataset string, trust int")


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    if name in llm.SQL:
        assert differences(spark, connect(FOLDER), llm.QUERIES[name], llm.SQL[name], FOLDER) == ""
    else:
        assert llm.QUERIES[name](spark, FOLDER).count() > 0


def test_overlap(spark):
    df = entries(spark, {}, {"commit_id": FULL.upper() + ".patch", "project_url": Q, "split": "test"}, {"commit_id": FULL[:9], "split": "validation"}, {"commit_id": FULL[:9], "project_url": Q + "x", "split": "test"},
                 {"commit_id": FULL[:9], "project_url": Q + "x"}, {"commit_id": None, "split": "test"}, {"commit_id": "n/a"}, {"split": None}, {"split": "other"}, {"project_url": None, "split": "test"})
    assert pairs(overlap.found(df)) == [(1, 2), (1, 3), (1, 10), (4, 5)]
    assert overlap.found(df.limit(0)).count() == 0
    report = {(r.split, r.src_dataset): (r.n_entries, r.n_leaked, r.n_pairs) for r in overlap.overlap_report(df).collect()}
    assert report == {("test", "s"): (3, 3, 3), ("validation", "s"): (1, 1, 1)}


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        else:
            [root(x) for x in (a, b) if x is not None]
    return sorted((root(x), x) for x in up)


@pytest.mark.parametrize("per_cell", [10, 1_000_000])
def test_components(spark, per_cell):
    r = random.Random(3)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)] + [(f"r{r.randrange(30)}", f"r{r.randrange(30)}") for _ in range(15)] + [("x", "x"), ("y", None), (None, "z"), ("c3", "c2"), ("c3", "c2")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert pairs(components.group_members(df, "a", "b", per_cell)) == brute(edges)
    assert components.group_members(df.limit(0), "a", "b").count() == 0


def test_union_find():
    u = np.arange(999)
    assert set(components.union_find(u, u + 1, 1000)) == {0}


def test_representative(spark):
    at = lambda y: datetime(y, 1, 1)
    df = entries(
        spark, {"commit": ("n/a", "d", [""], datetime(1970, 1, 1), None), "cve_ids": ["CVE-2019", None]}, {"commit": ("m", " ", ["f"], at(2020), at(2021)), "ingested_at": at(2020), "cve_ids": [" cve-2020-1234"]},
        {"commit": ("m2", None, None, None, None), "ingested_at": at(2021)}, {"commit": ("m3", "x" * 100_000, None, None, None), "src_datasets": ["t", None], "commit_id": FULL[:8]}, {"function_name": "f"}, {"commit_id": None}, {"commit_id": OTHER, "commit": None}, {"commit_id": OTHER, "cve_ids": None, "src_datasets": None},
    )
    assert pairs(representative.found(df, catalogue(spark))) == [(1, "authored_at", 2), (1, "committed_at", 2), (1, "cve_ids", 2), (1, "diff", 4), (1, "files_changed", 2), (1, "message", 4)]
    assert representative.found(df.limit(0), catalogue(spark)).count() == 0
    assert representative.found(df, catalogue(spark).limit(0)).where("field_name = 'message'").first().entry_id == 3
    groups = {r.first_id: r.n_entries for r in representative.surviving_entries(df, catalogue(spark)).collect()}
    assert groups == {1: 4, 7: 2}


def test_consensus(spark):
    assert consensus.closest(["fix overflow in the parser", "fix the overflow in parser", "fix the overflow in parser", "zzz"], [1, 1, 1, 5]) in (0, 1, 3)
    assert consensus.agreed([list("abcd"), list("abxd"), list("abcd")], [1.0, 1.0, 1.0]) == list("abcd")
    texts = ["fix a b c d", "fix a b c d", "fix a b x d", None, "no", "other words here", "fix a b c e", "fix a b c f"]
    df = entries(spark, *({"commit": (t, None, None, None, None)} for t in texts), {"commit_id": OTHER, "commit": ("one", None, None, None, None)}, {"commit_id": OTHER, "commit": NOTHING}, {"commit_id": "abcdef1"})
    for chunk in (2, 32):
        got = pairs(consensus.consensus_values(df, catalogue(spark), F.col("commit.message"), F.col("commit.message").isNotNull(), chunk))
        assert [g[0] for g in got] == [1, 9] and got[1] == (9, 9)
    assert pairs(consensus.consensus_messages(df, catalogue(spark)))[0] == (1, 1)
    assert consensus.consensus_messages(df.limit(0), catalogue(spark)).count() == 0


def test_canonical(spark):
    rows = [
        (1, P, FULL, '{"a": "X", "b": 1}'), (2, f" <{P.upper()}> ", f"'{FULL.upper()}'", "B=1;A=x"), (3, P, FULL, "a: 'x'\nb: '1'"), (4, P, FULL, "{'b' => '1', 'a' => 'x',}"), (5, P, FULL, "a: x | b: 2"), (6, P, FULL, '{"a": "X"}'),
        (7, None, None, None), (8, None, None, None), (9, "", "", ""), (10, P, FULL, "x" * 50_000 + "=1"), (11, P.replace("://", ":///"), FULL, '{"a":"x","b":1}'), (12, P, FULL, '{"a": "' + "y\\\"" * 20_000 + '"}'),
    ]
    df = spark.createDataFrame([(*r, "e", "w", 0) for r in rows], "raw_id long, project_url string, commit_id string, extra string, digest string, word string, bits long")
    assert pairs(canonical.copies(df)) == [(1, 2), (1, 3), (1, 4), (1, 11), (7, 8)]
    assert pairs(canonical.collapsed(df)) == [(1, 5), (5, 1), (6, 1), (7, 2), (9, 1), (10, 1), (12, 1)]
    assert canonical.copies(df.limit(0)).count() == 0 and canonical.collapsed(df.limit(0)).count() == 0


SAME = [  # texts of one record
    ['{"a": "X", "b": 1}', "B=1;A=x", "a: 'x'\nb: '1'", "{'b' => '1', 'a' => 'x',}", "a: x | b: 1", "a=1x, b=1".replace("1x", "x"), '{\n  "B" : "1",\n  "A" : "x"\n}'],
    ['{"n": "v | w; u", "m": 2}', "n: 'v | w; u'\nm: '2'"],
    ['{"cves": ["CVE-2020-1111","CVE-2020-2222"], "a": 1}', '{"A": "1", "cves": [ "cve-2020-1111", "CVE-2020-2222" ]}'],
    ["", "  ", "{}", "{ }"],
    ['{"a": {"b": {"c": 1}}, "d": 2}', '{"a": {"B": {"c": 1} }, "d":2}'],
]
OTHER_TEXTS = [
    '{"cves": ["CVE-2020-1111","CVE-2020-3333"], "a": 1}', '{"cves": ["CVE-2020-1111"], "a": 1}', '{"cves": "CVE-2020-1111", "a": 1}', "note: fix a, then b | x: 1", "note: fix a, then c | x: 1", '{"a": {"b": 1, "c": 2}, "d": 3}',
    '{"a": {"b": 1}, "c": 2, "d": 3}', '{"a": {"b": {"c": 1}, "d": 2}}', '{"a":1} {"b":2}', '{"a":1} {"b":3}', '{"a": "x"} tail', '{"a": "x"} other', "a=1;x;b=2", "a=1;b=2;x", "free text", '{"t": "say \\"a, b: c\\" ok"}', '{"t": "say \\"a, b: d\\" ok"}', "k=v=w;l=1", "k=v;l=1",
]


def test_different_records_stay_apart(spark):
    """Lists, nested objects, separators inside values, and texts that no form covers: nothing is left out of the comparison."""
    rows = [(g, t) for g, texts in enumerate([*SAME, *([t] for t in OTHER_TEXTS)]) for t in texts]
    df = spark.createDataFrame([(i, P, FULL, t) for i, (_, t) in enumerate(rows)], "raw_id long, project_url string, commit_id string, extra string")
    want = {}
    for i, (g, _) in enumerate(rows):
        want.setdefault(g, []).append(i)
    pairs_ = sorted((ids[0], i) for ids in want.values() for i in ids[1:])
    assert pairs(canonical.copies(df)) == pairs_
    assert pairs(canonical.collapsed(df)) == sorted((ids[0], len(ids)) for ids in want.values())


def test_no_single_record_is_shuffled(spark):
    """Whatever the number of slices of the filter, records are judged in place, and the results are the same."""
    df = spark.range(6000).select(F.col("id").alias("raw_id"), F.lit(P).alias("project_url"), F.lit(FULL).alias("commit_id"), F.concat(F.lit("k="), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000)).alias("extra")).repartition(5)
    one = pairs(canonical.collapsed(df))
    assert pairs(canonical.collapsed(df, slice_blocks=5)) == one and sum(n for _, n in one) == 6000 and max(n for _, n in one) == 2001
    assert pairs(canonical.copies(df, slice_blocks=7)) == pairs(canonical.copies(df))
    rows, slices = canonical.hashed(df, slice_blocks=5)
    assert slices == 5 and rows.select("slice").distinct().count() == 5
    _, single = canonical.possible_repeats(df, slice_blocks=5)
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_filters_never_lose_a_repeat(spark):
    df = spark.range(4000).select((F.col("id") % 2500).alias("k"), F.col("id").alias("raw_id"), F.lit(P).alias("project_url"), F.lit(FULL).alias("commit_id")).withColumn("extra", F.concat(F.lit("k="), F.col("k"))).repartition(7)
    maybe, single = canonical.possible_repeats(df)
    assert maybe.count() + single.count() == 4000 and maybe.count() >= 3000 and maybe.count() < 3200
    assert single.join(df, "raw_id").where("k < 1500").count() == 0


def test_splits(spark):
    rows = [{"project_url": f"https://f.example/o/r{i % 37}", "commit_id": f"{i % 60:040x}" if i % 5 else f"{i:07x}", "is_vfc": i % 3 == 0, "src_datasets": [f"s{i % 4}"] if i % 9 else None} for i in range(400)]
    df = entries(spark, *rows, {"project_url": None}, {"project_url": None, "commit_id": None}, {"project_url": "n/a", "commit_id": f"{1:040x}", "is_vfc": None})
    got = splits.grouped_split(df, buckets=8).collect()
    assert len(got) == 403 and len({r.entry_id for r in got}) == 403 and {r.split for r in got} <= set(splits.SPLITS)
    assert all(len({r.split for r in got if r.group_url == g}) == 1 for g in {r.group_url for r in got})
    groups = {r.entry_id: r.group_url for r in splits.found(df).collect()}
    assert groups[402] == "#entry 402" and groups[401] == "#" + FULL and groups[403] == groups[2]
    assert splits.found(df.limit(0)).count() == 0 and splits.grouped_split(df.limit(0)).count() == 0


def test_placing():
    units = [({"a": 10}, 10)] * 80 + [({"b": 1, "a": 9}, 10)] * 20
    got = splits.place(units, splits.SPLITS)
    assert got.count("train") == 80 and got[80:].count("train") == 16 and got[80:].count("test") == 2


def test_packing(spark):
    texts = ["word " * n for n in (1, 5, 40, 300, 700)] + ["", None, "same text here"] + ["same text here"] * 30 + ["z" * 60_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    targets = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0)], "target_id long, capacity_tokens int")
    size = {r.doc_id: r.n_tokens for r in packing.document_points(docs).collect()}
    for per_task in (10, 1000):
        rows = packing.packed(docs, targets, items_per_task=per_task).collect()
        for target, capacity in ((1, 64), (2, 512)):
            mine = [r for r in rows if r.target_id == target]
            boxes, whole = {}, {}
            for r in mine:
                boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
                whole.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
            assert max(boxes.values()) <= capacity and set(whole) == set(size)
            for doc, parts in whole.items():
                at = 0
                for start, n in sorted(parts):
                    assert start == at
                    at += n
                assert at == size[doc] and (len(parts) == 1 or size[doc] > capacity)
        assert {r.target_id for r in rows} == {1, 2}
    assert packing.packed(docs.limit(0), targets).count() == 0 and packing.packed(docs, targets.limit(0)).count() == 0


def test_containers_are_filled_from_nearby():
    r = random.Random(9)
    sizes = [r.randrange(1, 512) for _ in range(3000)]
    packer, boxes = packing.Packer(512, 256, 1 / 128), {}
    for at, n in enumerate(sizes):
        for box, (m, i) in packer.put((n, at)):
            boxes.setdefault(box, []).append((i, m))
    for box, (m, i) in packer.close():
        boxes.setdefault(box, []).append((i, m))
    assert sorted(i for b in boxes.values() for i, _ in b) == list(range(3000)) and max(sum(m for _, m in b) for b in boxes.values()) <= 512
    several = [b for b in boxes.values() if len(b) > 1]
    assert sum(max(i for i, _ in b) - min(i for i, _ in b) for b in several) / len(several) < 3000 / 10
    assert packing.chosen([5, 3, 9, 4], 12, 0) == [2, 1] and packing.chosen([], 5, 0) == [] and packing.chosen([7], 5, 0) == []


def test_hilbert():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert len(set(keys.tolist())) == 512 and np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_leakage(spark):
    r = random.Random(7)
    vocabulary = [f"w{i:03d}" for i in range(400)]
    item = [r.choice(vocabulary) for _ in range(120)]
    edited = list(item[20:60])
    edited[5], edited[15], edited[30] = "new", "other", "third"
    docs = [
        "intro " + " ".join(item[10:40]) + " end", " ".join(edited), " ".join(item[10:38]), "", None, " ".join(f"<b>{w.upper()}</b>,\n" for w in item[50:85]), " ".join(r.choice(vocabulary) for _ in range(3000)),
        " ".join(item[0:15] + ["x"] * 12 + item[15:30]), "a " * 100_000 + " ".join(item), "&lt;i&gt;" + "&nbsp;".join(item[:31]), "\\n".join(item[:31]),
    ]
    df = spark.createDataFrame([(i, d, 1) for i, d in enumerate(docs)] + [(0, docs[0], 1), (None, docs[0], 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, " ".join(item)), (4, " ".join(item))], "item_id long, text string")
    want = sorted((d, i) for d in (0, 1, 5, 8, 9, 10) for i in (1, 4))
    assert pairs(leakage.leaked_items(df, items)) == want and pairs(leakage.leaked_items(df, items, block=1)) == want
    assert leakage.leaked_items(df.limit(0), items).count() == 0 and leakage.leaked_items(df, items.limit(0)).count() == 0


def test_leakage_recall():
    """Passages of 36 words with three random edits: nearly all must be found."""
    r = random.Random(5)
    items = [(i, [f"w{r.randrange(900)}" for _ in range(100)]) for i in range(40)]
    index, hit, tries = leakage.Index(items), 0, 400
    for _ in range(tries):
        k = r.randrange(40)
        at = r.randrange(60)
        passage = list(items[k][1][at : at + 36])
        for _ in range(3):
            passage[r.randrange(len(passage))] = f"w{r.randrange(900)}"
        text = [f"w{r.randrange(900)}" for _ in range(40)] + passage + [f"w{r.randrange(900)}" for _ in range(40)]
        coded = np.array([index.ids.get(w, 0) for w in text])
        hit += (0, k) in leakage._find(index, [coded])
    assert hit >= 0.97 * tries


def test_spam(spark):
    prose = "The parser now checks the length of the header before it copies the data, so that a client can no longer write past the end of the buffer. " * 3
    other = "We found that the old code did not handle an empty request, and the server would wait for the next one until it was restarted by hand. "
    keys = ["cheap hosting", "vpn coupon", "zero day", "crack tool"]
    r = random.Random(1)
    docs = {
        1: ", ".join(r.choice(keys) for _ in range(60)), 2: other + "\n" + "\n".join(f"https://www.x{i}.test/p Top {i} tricks" for i in range(30)), 3: " ".join(f'<a href="http://h{i}.test/">{r.choice(keys)}</a>,' for i in range(20)),
        4: " > ".join(r.choice([*keys, "Home", "Login", "RSS", "Tags"]) for _ in range(40)), 5: " ".join(f"{a} {r.choice(keys)}" if i % 2 else a for i, a in enumerate((prose + other).split())), 6: " ".join("#" + r.choice(keys).replace(" ", "") for _ in range(30)),
        11: prose + other, 12: other + "\n" + "\n".join(f"#{i} 0x{r.getrandbits(40):x} in f{i} a/b.c:{i}" for i in range(60)), 13: other + "\n" + "\n".join(f"{r.getrandbits(256):064x}" for _ in range(20)), 14: "", 15: None, 16: "fix overflow", 17: other + prose + "\nReferences\n- http://a.test/x\n- http://b.test/y",
        18: "a" * 200_000, 19: "1.2" * 50_000 + "x",
    }
    vocabulary = ["".join(r.choice(["ka", "re", "to", "mi", "lun", "ser", "ter", "do", "pa", "sti"]) for _ in range(1 + i % 4)) for i in range(900)]
    common = [1 / (i + 3) for i in range(900)]
    usual = [" ".join(" ".join(r.choices(vocabulary, common, k=r.randrange(9, 20))).capitalize() + "." for _ in range(n % 24 + 1)) for n in range(300)]
    docs |= {1000 + i: t for i, t in enumerate(usual)}
    df = spark.createDataFrame([(i, t, None if i == 1 else "EN-us", 0) for i, t in docs.items()] + [(None, docs[1], "en", 0)], "doc_id long, text string, lang string, size long")
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    assert got - {18, 19} == {1, 2, 3, 4, 5, 6}
    assert spam.spam_pages(df.limit(0)).count() == 0
    lines = df.limit(0).unionByName(df.where("doc_id >= 1000")).unionByName(spark.createDataFrame([(1, "\n".join(["vpn coupon", "zero day"] * 6), "en", 0), (2, "fix overflow", "en", 0), (3, "see https://a.test/x", "en", 0)], df.schema))
    assert {r.doc_id for r in spam.spam_pages(lines).collect()} == {1}  # short, but several lines of keywords


PROSE = {
    "ru": "Разбор заголовка теперь проверяет длину поля до копирования данных. Раньше клиент мог записать байты за пределами буфера, и сервер аварийно завершался. Мы добавили тест, который повторяет ошибку на старой версии. Обновление рекомендуется всем, кто принимает запросы из внешней сети.",
    "pl": "Parser nagłówka sprawdza teraz długość pola przed skopiowaniem danych. Wcześniej klient mógł zapisać bajty poza końcem bufora, a serwer kończył pracę z błędem. Dodaliśmy test, który odtwarza problem na starej wersji. Aktualizację zalecamy wszystkim, którzy przyjmują żądania z sieci zewnętrznej.",
    "nl": "De parser controleert nu de lengte van het veld voordat de gegevens worden gekopieerd. Eerder kon een client bytes voorbij het einde van de buffer schrijven, waarna de server vastliep. We hebben een test toegevoegd die de fout in de oude versie laat zien. Iedereen die verzoeken van buiten aanneemt, zou moeten bijwerken.",
    "sv": "Tolken kontrollerar nu fältets längd innan den kopierar data. Tidigare kunde en klient skriva byte förbi slutet på bufferten, och servern stannade. Vi har lagt till ett test som visar felet i den gamla versionen. Alla som tar emot anrop utifrån bör uppdatera så snart som möjligt.",
    "it": "Il parser ora controlla la lunghezza del campo prima di copiare i dati. In precedenza un client poteva scrivere oltre la fine del buffer e il server si fermava. Abbiamo aggiunto una prova che riproduce il difetto nella vecchia versione. Chi riceve richieste dalla rete esterna dovrebbe aggiornare appena possibile.",
    "zh": "解析器现在会在复制数据之前检查字段的长度。以前，客户端可以把字节写到缓冲区之外，服务器随后崩溃。我们增加了一个测试，用来在旧版本上重现这个错误。建议所有从外部网络接收请求的用户尽快升级。",
}


@pytest.mark.parametrize("known", [False, True])
def test_prose_of_any_language_is_no_spam(spark, known):
    """Whether the corpus knows the language (many documents of it) or only its length counts."""
    r = random.Random(2)
    rows = []
    for lang, text in PROSE.items():
        parts = [p + ("。" if lang == "zh" else ".") for p in re.split(r"[.。]\s*", text) if p]
        for i in range(120 if known else 3):
            rows.append((len(rows), ("" if lang == "zh" else " ").join(r.sample(parts, len(parts)) * (1 + i % 2)), lang))
    real = len(rows)
    words = "купить дешёвый хостинг ключ скидка антивирус взлом бесплатно".split()
    rows.append((real, ", ".join(r.choice(words) for _ in range(90)), "ru"))
    english = " ".join(PROSE["it"].split())
    rows += [(real + 1 + i, " ".join(f"{w}{r.randrange(60)}" if len(w) > 5 else w for w in english.split()) * (1 + i % 3), "en") for i in range(200)]
    got = {x.doc_id for x in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {real}


def test_every_character_counts():
    """The last block is no exception: redundancy after the first 2,048 characters is seen."""
    r = random.Random(4)
    head = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2048))
    assert spam.block_ratio(head + "z" * 1000) < 0.8 * spam.block_ratio(head + "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1000)))


def test_majority_is_the_consensus():
    """A value with more than half of the weight is what aligning and voting gives, so it needs neither."""
    r = random.Random(8)
    for _ in range(200):
        texts = list({" ".join(r.choice("ab cd ef gh".split()) for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(2, 6))})
        weights = [r.random() for _ in texts]
        lead = r.randrange(len(texts))
        weights[lead] = sum(w for i, w in enumerate(weights) if i != lead) * 1.01 + 0.01
        assert consensus.closest(texts, weights) == lead


def test_ranked_rule_is_a_vote(spark):
    """p5_found: where each rank outweighs all lower ones together, the vote gives the first-ranked value."""
    r, at = random.Random(6), [datetime(2020, 1, d) for d in (1, 2, 3)]
    rows = [{"commit_id": f"{g:040x}", "commit": (" ".join(r.choice("fix the old parser bug".split()) for _ in range(4)), None, None, None, None), "src_datasets": [r.choice("stu")], "ingested_at": r.choice([None, *at])} for g in range(12) for _ in range(5)]
    df = entries(spark, *rows)
    trust = {"s": 2, "t": 1, "u": 2_147_483_647}
    for row in representative.found(df, catalogue(spark)).where("field_name = 'message'").collect():
        g = rows[row.entry_id - 1]["commit_id"]
        mine = [(i + 1, x) for i, x in enumerate(rows) if x["commit_id"] == g]
        order = sorted(mine, key=lambda m: (trust[m[1]["src_datasets"][0]], -(m[1]["ingested_at"] or datetime(1, 1, 1)).toordinal(), m[0]))
        weight = {i: 2.0 ** -k for k, (i, _) in enumerate(order)}
        votes = {}
        for i, x in mine:
            votes[x["commit"][0]] = votes.get(x["commit"][0], 0) + weight[i]
        texts = list(votes)
        winner = texts[consensus.closest(texts, [votes[t] for t in texts])]
        assert rows[row.entry_id - 1]["commit"][0] == winner and row.entry_id == order[0][0]


@pytest.mark.parametrize("kind", ["replaced", "added", "missing"])
@pytest.mark.parametrize("tail", [False, True])
def test_leakage_recall_of_the_shortest_passages(kind, tail):
    """30 words of an item with three edits, the hardest case there is, in an even and in a heavy-tailed vocabulary.

    A passage begins and ends with a word of the item; with three words missing it takes 33 of them.
    """
    r = random.Random(11)
    weights = [1 / (i + 3) if tail else 1 for i in range(900)]
    word = lambda: f"w{r.choices(range(900), weights)[0]}"
    items = [(i, [word() for _ in range(100)]) for i in range(30)]
    index, hit, tries = leakage.Index(items), 0, 200
    for _ in range(tries):
        k, at = r.randrange(30), r.randrange(60)
        passage = list(items[k][1][at : at + 30])
        places = sorted(r.sample(range(1, 29), 3), reverse=True)
        for p in places:
            if kind == "replaced":
                passage[p] = "x" + word()
            elif kind == "added":
                passage.insert(p, word())
            else:
                del passage[p]
        text = [word() for _ in range(40)] + passage + [word() for _ in range(40)]
        coded = np.array([index.ids.get(w, 0) for w in text])
        hit += (0, k) in leakage._find(index, [coded])
    print(kind, tail, hit / tries)
    assert hit >= 0.96 * tries


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_field_has_a_consensus(spark, tmp_path):
    sha, t1, t2 = "0123456789abcdef0123456789abcdef01234567", datetime(2024, 1, 1), datetime(2024, 1, 2)
    url = "https://f.example/a/b"
    one, odd = ("fix the overflow", "+ a b c", ["a.c", "b.c"], t1, t2), ("zzz", "+ q", ["q.c"], t2, t1)
    rows = [(1, url, sha, None, ["CVE-2020-0009"], ["u"], odd), (2, url, sha, None, ["CVE-2020-0001"], ["s", "t"], one), (3, url, sha, None, ["CVE-2020-0001"], ["t", "s"], one), (4, url, sha, "f", [], ["s"], one)]
    empty = ("n/a", None, [], None, None)
    rows += [(i, url, "f" * 40, None, None, ["s"], empty) for i in (5, 6)]
    d = save(spark, tmp_path, "entries", [*rows, rows[1]], "entry_id long, project_url string, commit_id string, function_name string, cve_ids array<string>, src_datasets array<string>, commit struct<message:string,diff:string,files_changed:array<string>,authored_at:timestamp,committed_at:timestamp>")
    save(spark, tmp_path, "src_catalog", [("s", 1), ("t", 1), ("u", 1)], "src_dataset string, trust int")
    got = {r.first_id: r for r in llm.QUERIES["p5_consensus"](spark, d).collect()}
    assert set(got) == {1, 5}
    r = got[1]
    assert (r.project_url, r.commit_id, r.function_name, r.cve_ids, sorted(r.src_datasets)) == (url, sha, None, ["CVE-2020-0001"], ["s", "t"])
    assert (r.message, r.diff, r.files_changed, r.authored_at, r.committed_at) == one
    assert (got[5].src_datasets, got[5].cve_ids, got[5].message, got[5].diff, got[5].authored_at) == (["s"], None, None, None, None)
