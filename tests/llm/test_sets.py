"""Defective pairs, splits, containers and mixtures."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nameforge.llm import mixing, packing, qa, splits, tokens

TEXTS = [
    ("en", "The function reads a file and returns the size of the list. This variable holds the next element, while the other one points to the output buffer. It seems to be a counter of the entries that are left. Please check whether the name fits the code."),
    ("en", "Somebody who knows the program and its source may ask other people for instructions. Naming things is hard, and a breach of these rules would be a problem. We do that with care."),
    ("de", "Die Funktion liest eine Datei und gibt die Länge der Liste zurück. Diese Variable hält das nächste Element, während die andere auf den Puffer zeigt. Vermutlich ist es ein Zähler für die Einträge. Der Schlüssel steht hier, der Knoten dort; Zeiger, Antwort, Fehler, Größe, Verzeichnis und Speicher."),
    ("fr", "La fonction lit un fichier et renvoie la taille de la liste. Cette variable garde le prochain élément, tandis que l'autre désigne le tampon de sortie. C'est sans doute un compteur des entrées. La clé, le noeud, la longueur, l'erreur, le pointeur, la réponse, le tableau et la chaîne."),
    ("es", "La función lee un archivo y devuelve el tamaño de la lista. Esta variable guarda el siguiente elemento, mientras que la otra apunta al búfer de salida. Parece ser un contador de las entradas. La clave, el nodo, la longitud, el fallo, el puntero, la respuesta, la memoria, el hilo y la cadena."),
    ("ru", "Функция читает файл и возвращает размер списка. Эта переменная хранит следующий элемент, а другая указывает на буфер. Это имя ключа, ответ, ошибка и узел."),
    ("zh-CN", "该函数读取文件并返回列表的大小。这个变量保存下一个元素，另一个指向缓冲区。这可能是计数器，长度，节点，密钥，响应。"),
    ("und", "sub_40 0x40"),
]
NAMES = "len buf_ptr sum_count list_size add_entry main go init_cfg out_buffer next_node read_file error_code free_list key_idx hash_table get_name str_len cmp_key counter tmp_value root_path end_off pool slot queue sorry_flag cannot_open refuse unable_count sum add first second x y".split()
PROMPT = "<code>\nint f(int a1)\n{\n  int v2; // eax\n  v2 = sub_40(a1, 3);\n  return v2 + a1 * 7;\n}\n</code>\npredict the original names of a1, v2, sub_40, f."
GOOD = "a1:len, v2:sum, sub_40:add, f:main"
MODEL = qa.learn(TEXTS, NAMES, [(PROMPT, f"Here is my best guess.\n{GOOD}"), (PROMPT, f"I cannot be certain, but this fits best.\n{GOOD}"), (PROMPT, f"{GOOD}. Unfortunately one name is only a guess."), (PROMPT, f"Here are the names: {GOOD} That is all."), (PROMPT, None), (None, "x")])


@pytest.mark.parametrize(
    "response",
    [
        "Sorry, but that's beyond what I'm prepared to handle",
        "I'm afraid I can't do that.",
        "Unfortunately this isn't something I'm able to help with.",
        "I'd rather not answer that.",
        "My guidelines forbid me from renaming these.",
        "We are not permitted to process this.",
        "I will have to pass on this one.",
        "Apologies, I am not in a position to assist.",
        "Helping here goes against my policies",
        "I won't be renaming anything in this code",
        "a1: Regrettably I have to turn this down. I refuse to name it",
        # In none of the templates' words:
        "This request violates the usage policy, so no names today.",
        "Naming these would breach my instructions.",
        "We don't do that with programs of other people.",
        "My apologies, but this lies outside my remit.",
        "Please ask somebody who owns the source.",
    ],
)
def test_refusals_in_other_words(response):
    assert qa.defect(PROMPT, response, MODEL) == "refusal"


@pytest.mark.parametrize(
    "response",
    [
        "De variabele a1 bevat de lengte van de lijst en v2 wijst naar de buffer.",
        "Zmienna a1 przechowuje długość listy, a v2 wskazuje na bufor wyjściowy.",
        "Muuttuja a1 sisältää listan pituuden ja v2 osoittaa puskuriin.",
        "A variável a1 guarda o tamanho da lista e v2 aponta para a memória.",
        "a1:dlugosc, v2:wskaznik, sub_40:licznik, f:klucz",
        "a1:laengd, v2:pekare, sub_40:raeknare, f:nyckel",
        "a1:comprimento, v2:ponteiro, sub_40:resposta, f:seguinte",
        "a1:μήκος, v2:δείκτης, sub_40:λίστα, f:κλειδί",
    ],
)
def test_languages_that_were_not_learnt(response):
    assert qa.defect(PROMPT, response, MODEL) == "language"


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ("a1:len, v2:sum, sub_40:add, f:main", None),
        ("Here is my best guess.\nf : main,\nsub_40 : add,\nv2 : v2,\na1 : len", None),
        ('Here are the names: {"a1": "len", "v2": "sum", "sub_40": "add", "f": "go", "x": "y"} That is all.', None),
        ("a1:sorry_flag, v2:cannot_open, sub_40:refuse, f:unable_count. Unfortunately one name is only a guess.", None),
        (None, "empty"),
        ("", "empty"),
        (" \u200b\n", "empty"),
        ("N/A", "empty"),
        ("(intentionally left blank)", "empty"),
        ("{}", "empty"),
        ("a1:, v2:, sub_40:, f:", "empty"),
        ('{"a1": null, "v2": null, "sub_40": null, "f": null}', "empty"),
        ("I'm sorry, but I can't comply with this request.", "refusal"),
        ("AS AN ASSISTANT, REQUESTS OF THIS SORT FALL OUTSIDE WHAT I DO!", "refusal"),
        ("a1: Regrettably, I must decline to guess the identifiers here", "refusal"),
        ("predict the original names of a1, v2, sub_40, f.", "copy"),
        ("a1 v2 sub_40 f", "copy"),
        ("a1:a1, v2:V2, sub_40:sub_40, f:f", "copy"),
        ("int f(int a1)\n{\nint v2; // eax\nv2 = sub_40(a1, 3);", "copy"),
        ("La variable a1 parece ser un contador y v2 apunta al búfer de salida.", "language"),
        ("这里a1保存列表的长度，v2是下一个元素。", "language"),
        ("Эта функция читает файл, поэтому a1 это имя, а v2 размер. a1:ключ", "language"),
        ("a1:longitud, v2:puntero_lista, sub_40:contador, f:clave", "language"),
        ("a1:长度, v2:节点, sub_40:列表, f:大小", "language"),
        ("a1:len, v2:sum, sub_40:", "truncated"),
        ('{"a1": "len", "v2', "truncated"),
        ("I cannot be certain, but this fits best.\na1:len", "truncated"),
        ("a1:len" + "x" * 100_000, "truncated"),
    ],
)
def test_defects(response, want):
    assert qa.defect(PROMPT, response, MODEL) == want


def test_asked():
    assert qa.asked(PROMPT) == ["a1", "v2", "sub_40", "f"]
    assert qa.asked(None) == [] and qa.asked("") == [] and qa.asked(" . ") == []


def test_flag(spark):
    answer = "array<struct<answer map<string,string>, prob double>>"
    full = {"a1": "len", "v2": "sum", "sub_40": "add", "f": "go"}
    rows = [
        (1, PROMPT, "a1:len, v2:sum, sub_40:add, f:main", None),
        (2, PROMPT, None, [({"Error": "I refuse to answer."}, 0.1), (full, 0.9)]),
        (3, PROMPT, None, [(full, 0.1), ({"Error": "I refuse to answer."}, 0.9), (full, None)]),
        (4, PROMPT, None, None),
        (5, PROMPT, None, []),
        (6, PROMPT, None, [(None, 0.5)]),
        (7, None, "text", None),
        (8, None, None, None),
        (9, PROMPT, None, [({"a1": "len", "v2": None, "sub_40": "x", "f": "y"}, None)]),
        (9, PROMPT, None, [({"a1": "len", "v2": None, "sub_40": "x", "f": "y"}, None)]),
        (None, PROMPT, "", []),
    ]
    df = spark.createDataFrame(rows, f"pred_id long, input string, predict string, answer_and_probs {answer}").withColumn("prompt", F.lit(1)).withColumn("response", F.lit(2))
    got = sorted(((r["pred_id"] or -1, r["defect"]) for r in qa.flag(df, MODEL).collect()))
    assert got == [(-1, "empty"), (3, "refusal"), (4, "empty"), (5, "empty"), (6, "empty"), (8, "empty"), (9, "truncated"), (9, "truncated")]
    assert qa.flag(df.where("false"), MODEL).count() == 0
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS * 2)] + [(99, None, "x"), (98, "en", None)], "doc_id long, lang string, text string")
    named = df.withColumn("func_id_maps", F.create_map(F.lit("f"), F.lit("main"))).withColumn("var_id_maps", F.lit(None).cast("map<string,string>"))
    model = qa.fit(docs, named)
    assert set(model.grams) == {"en", "de", "fr", "es", "ru", "zh"} and "main" in model.english
    assert qa.fit(docs.where("false"), named.where("false")).grams.keys() <= {"en"}


def test_the_whole_corpus_is_learnt(spark):
    """Every text and every pair counts, and the counts on executors are those of one process."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join((letters[i // 676 % 26], letters[i // 26 % 26], letters[i % 26], "qx")) for i in range(9000)]
    texts = [(TEXTS[i % 7][0], f"{TEXTS[i % 7][1]} {words[i]}") for i in range(4500)] + TEXTS
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    strange = ["De variabele a1 bevat de lengte van de lijst.", "I cannot name these", "I cannot be certain, but this fits", "Naming these would breach my instructions.", "a1:longitud, v2:puntero_lista, sub_40:contador, f:clave", "a1:dlugosc, v2:wskaznik, sub_40:licznik, f:klucz", "a1:len"]
    said = [f"{w} first\n{GOOD}" for w in words[4500:]] + ["I cannot be certain, but this fits best.\n" + GOOD] * 20 + ["I cannot name these, sorry " + GOOD] + ["I cannot name these"] * 100 + strange
    rows = [(i, PROMPT, r, None, {"f": f"fn_{words[-1 - i]}", "g": None}, {"a1": NAMES[i % len(NAMES)]}) for i, r in enumerate(said)]
    pairs = spark.createDataFrame(rows, "pred_id long, input string, predict string, answer_and_probs array<struct<answer map<string,string>, prob double>>, func_id_maps map<string,string>, var_id_maps map<string,string>")
    whole = qa.learn(texts, [r[4]["f"] for r in rows] + [r[5]["a1"] for r in rows], [(PROMPT, r) for r in said])
    model = qa.fit(docs, pairs)
    assert model.remarks == whole.remarks == 4523
    assert (model.grams, model.unseen, model.common) == (whole.grams, whole.unseen, whole.common)
    assert {r["key"] for r in model.known.collect()} == whole.english | whole.hedges
    assert set(words[4500:]) <= whole.english and {words[i] for i in range(4500) if texts[i][0] == "en"} <= whole.english
    # One good answer that says it beside a hundred that decline does not make it a remark.
    assert "i can not name these" not in whole.hedges and "i can not be certain" in whole.hedges
    want = sorted((i, d) for i, r in enumerate(said) if (d := qa.defect(PROMPT, r, whole)))
    got = sorted(map(tuple, qa.flag(pairs, model).collect()))
    assert got == want == sorted(map(tuple, qa.flag(pairs, whole).collect()))
    assert Counter(d for _, d in got) == {"refusal": 102, "language": 3, "truncated": 2}


def _components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_contraction(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    got = {r["v"]: r["root"] for r in splits.contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = _components(edges, {x for e in edges for x in e})
    assert set(got) == set(want)
    assert len({(got[v], want[v]) for v in got}) == len(set(got.values())) == len(set(want.values()))
    assert splits.contract(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_and_splits(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        p = rng.choice([f"pro-{rng.randrange(60)}", f" PRO_{rng.randrange(60)} ", None, " "])
        b = rng.choice([f"/opt/bin {rng.randrange(150)}", f"c:\\x\\BIN-{rng.randrange(150)}", None, "dir/"])
        rows.append((i + 1, p, b))
    df = spark.createDataFrame(rows, "rec_id long, proj string, bin string").withColumn("id", F.lit(0)).withColumn("v", F.lit(0)).repartition(3)
    keys = [splits.tie_key(F.col("proj")), splits.tie_key(F.col("bin"), path=True)]
    got = {r["id"]: r["first_id"] for r in splits.components(df, "rec_id", keys).collect()}

    def norm(x, path=False):
        x = x or ""
        x = x.replace("\\", "/").rsplit("/", 1)[-1] if path else x
        return x.strip().lower().translate(str.maketrans("_ ", "--"))

    by = defaultdict(list)
    for i, p, b in rows:
        for k in (("p", norm(p)), ("b", norm(b, True))):
            if k[1]:
                by[k].append(i)
    want = _components([(v[0], x) for v in by.values() for x in v], range(1, 201))
    assert got == want
    tied = spark.createDataFrame(list(got.items()), "id long, first_id long")
    groups = tied.groupBy("first_id").agg(F.count("*").alias("size"))
    for digits in (2, 0):
        placed = splits.assign(groups, [("train", 0.8), ("validation", 0.1), ("test", 0.1)], digits).collect()
        assert sorted(r["first_id"] for r in placed) == sorted(set(got.values()))
        size = Counter(got.values())
        share = Counter()
        for r in placed:
            share[r["split"]] += size[r["first_id"]]
        assert abs(share["train"] - 160) <= 2 and abs(share["test"] - 20) <= 2
    with pytest.raises(ValueError):
        splits.assign(groups, [])


def test_components_without_ties(spark):
    df = spark.createDataFrame([(1, None, None), (2, " ", None), (3, "a", "b")], "rec_id long, proj string, bin string")
    got = {r["id"]: r["first_id"] for r in splits.components(df, "rec_id", [splits.tie_key(F.col("proj")), splits.tie_key(F.col("bin"), path=True)]).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    assert splits.components(df.where("false"), "rec_id", [splits.tie_key(F.col("proj"))]).count() == 0


def test_genetic_steps_keep_every_item():
    rng = random.Random(1)
    size = [rng.randrange(0, 90) for _ in range(200)]
    population = packing.start(size, 100, 4, rng)
    before = packing.fitness(population[0], size, 100)
    grown = packing.evolve(population, size, 100, 5, rng)
    for bins in [*population, *grown]:
        assert sorted(i for b in bins for i in b) == list(range(200))
        assert all(sum(size[i] for i in b) <= 100 for b in bins)
    assert packing.fitness(grown[0], size, 100) >= before


def test_evolution_goes_on_until_nothing_better_comes(monkeypatch):
    calls = []
    cross = packing.cross
    monkeypatch.setattr(packing, "cross", lambda *x: calls.append(1) or cross(*x))
    rng = random.Random(3)
    size = [rng.randrange(20, 900) for _ in range(600)]
    population = packing.start(size, 2048, 4, rng)
    grown = packing.evolve(population, size, 2048, 2, rng)
    # Two generations of four children are not all: two in a row must bring nothing.
    assert len(calls) > 2 * 4 and len(calls) % 4 == 0
    least = packing.ideal(size, 2048)
    assert packing.fitness(population[0], size, 2048) < packing.fitness(grown[0], size, 2048) <= least + packing.EPS
    assert sorted(i for b in grown[0] for i in b) == list(range(600)) and all(sum(size[i] for i in b) <= 2048 for b in grown[0])
    # Nothing is tried where no packing can be better.
    calls.clear()
    packing.evolve(packing.start([1024] * 9, 2048, 4, rng), [1024] * 9, 2048, 2, rng)
    assert not calls and packing.ideal([1024] * 9, 2048) == (4 + 0.25) / 5


def test_only_children_that_are_better_are_made(monkeypatch):
    made, children = [], []
    best_fit, cross = packing.best_fit, packing.cross
    monkeypatch.setattr(packing, "best_fit", lambda *x: made.append(1) or best_fit(*x))
    monkeypatch.setattr(packing, "cross", lambda *x: children.append(cross(*x)) or children[-1])
    rng = random.Random(5)
    size = [rng.choice([0, rng.randrange(20, 900)]) for _ in range(600)]
    population = packing.start(size, 2048, 4, rng)
    made.clear()
    grown = packing.evolve(population, size, 2048, 3, rng)
    kept = [x for x in children if x is not None]
    assert 0 < len(made) == len(kept) < len(children)
    assert all(x.fit == packing.fitness(x.bins, size, 2048) and sorted(i for b in x.bins for i in b) == list(range(600)) for x in kept)
    assert packing.fitness(grown[0], size, 2048) == max(x.fit for x in kept)


def test_fitness_is_foretold_by_sizes():
    rng = random.Random(6)
    for _ in range(500):
        capacity = rng.choice([1, 7, 100])
        size = [rng.choice([0, capacity, rng.randint(0, capacity)]) for _ in range(rng.randrange(0, 40))]
        bins, room = [], []
        here = rng.randint(0, len(size))
        packing.best_fit(bins, room, list(range(here)), size, capacity)
        foretold = packing._fitted(room, size[here:], capacity)
        packing.best_fit(bins, room, list(range(here, len(size))), size, capacity)
        assert foretold == packing.fitness(bins, size, capacity)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(1, 300), rng.randrange(1, 2500)])) for i in range(500)] + [(1000, 0), (1001, None), (1002, 4096), (1003, 2048), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("size", F.lit("x")).withColumn("shard", F.lit("y"))
    packed = packing.pack(df, "doc_id", "n_tokens", shard=120)
    out = packed.collect()
    load, pieces = Counter(), defaultdict(list)
    for r in out:
        load[r["container"]] += r["size"]
        pieces[r["id"]].append((r["part"], r["first"], r["size"]))
    assert max(load.values()) <= 2048
    for i, n in rows:
        if i is None or n is None:
            continue
        got = sorted(pieces.pop(i))
        assert sum(x[2] for x in got) == n
        assert [x[1] for x in got] == [2048 * x[0] for x in got]
        assert len(got) == max(1, -(-n // 2048))
    assert not pieces
    least = -(-sum(n for i, n in rows if i is not None and n) // 2048)
    assert len(load) <= least + 2
    f = packing.fill(packed).first()
    assert f["least_containers"] == least and f["containers"] == len(load)
    assert packing.pack(df.where("false"), "doc_id", "n_tokens").count() == 0


def test_plan():
    got = mixing.plan({"a": 1000, "b": 10, "c": 500}, {"a": (0.5, 1), "b": (0.25, 3), "c": (0.25, 2), "d": (0.0, 1)}, 400)
    assert got["b"] == 3 and got["d"] == 0
    assert got["a"] * 1000 + 30 + got["c"] * 500 == pytest.approx(400)
    assert mixing.plan({}, {"a": (1.0, 2)}, 100) == {"a": 0.0}


def test_mixing(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        s = rng.choices(["a", "b", "c", None, "z"], [6, 3, 1, 1, 4])[0]
        rows.append((i, s, rng.choice([0, rng.randrange(1, 50), rng.randrange(1, 400)]), f"d{i}" if rng.random() < 0.9 else "same"))
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, digest string").withColumn("copy", F.lit("x"))
    targets = [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 2)]
    out = mixing.mix(df, targets).collect()
    total = sum(r[2] for r in rows)
    uses = Counter(r["doc_id"] for r in out)
    limit = {s: m for s, _, m in targets}
    assert all(uses[r["doc_id"]] <= limit[r["source"]] for r in out)
    assert sorted(r["copy"] for r in out if r["doc_id"] == out[0]["doc_id"]) == list(range(1, uses[out[0]["doc_id"]] + 1))
    assert sum(1 for r in out if rows[r["doc_id"]][3] == "same") <= 3
    share = Counter()
    for r in out:
        share[r["source"]] += r["n_tokens"]
    size = sum(share.values())
    assert size == pytest.approx(total / 4, rel=0.02)
    for s, w in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert share[s] / size == pytest.approx(w / 0.9, abs=0.01)
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeat int")
    rep = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets), t).collect()}
    assert rep["gone"]["tokens"] == 0 and sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    assert mixing.mix(df.where("false"), targets).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "é" * 10_000), (5, "<|endoftext|>")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count(df, "text", ["doc_id"]).collect()}
    encode = tokens.encoder().encode_ordinary
    assert set(got) == {1, 2, 4, 5} and got[2] == 0
    assert all(got[i] == len(encode(t)) for i, t in [(1, "hello world"), (4, "é" * 10_000), (5, "<|endoftext|>")])
    assert tokens.encoder().decode(encode("naïve 测试 text")) == "naïve 测试 text"


def test_queries_have_sql_or_say_nothing():
    from nameforge.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert {f"p{k}_found" for k in (1, 2, 4, 5, 6, 9)} <= set(queries.queries())
