import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import providers, text
from graphloom.operators import pages
from graphloom.sources import files
from graphloom.storage import Steps
from graphloom.streaming import watch


def build(new):
    paragraphs = new.select("path", files.decoded("path", "content").alias("t")).select("path", F.posexplode(text.split_paragraphs("t")).alias("para_no", "text"))
    return providers.extract(paragraphs).where("h IS NOT NULL").select("h", "r", "u", F.col("path").alias("source"))


def test_watch_processes_new_and_changed_files_once(spark, tmp_path):
    root = tmp_path / "raw" / "sub"
    root.mkdir(parents=True)
    (root / "a.txt").write_text("x | made_of | y\nnoise")
    (root / "_control.txt").write_text("no | no | no")
    (root / "b.bin").write_bytes(b"\0")
    paths = [str(tmp_path / n) for n in ("manifest", "triples", "checkpoint")]
    watch.watch(spark, str(tmp_path / "raw"), build, *paths, once=True).awaitTermination()
    (root / "b.md").write_bytes(b"p | q | r\xff")
    watch.watch(spark, str(tmp_path / "raw"), build, *paths, once=True).awaitTermination()
    (root / "a.txt").write_text("x | made_of | z")
    before = spark.read.parquet(paths[1]).count()
    for epoch in (0, 1):  # a repeated epoch, even after its records were written, takes nothing away
        own = spark.read.format("binaryFile").load(str(root / ("a.txt" if not epoch else "b.md")))
        if epoch:
            watch.process(own, build, *paths[:2], epoch=epoch)
    assert spark.read.parquet(paths[1]).count() == before == 2
    assert watch.rescan(spark, str(tmp_path / "raw"), build, *paths[:2]) == -1
    assert watch.rescan(spark, str(tmp_path / "raw"), build, *paths[:2]) == -2
    assert spark.read.parquet(f"{paths[1]}/epoch=-2").count() == 0
    got = sorted((r.h, r.r, r.u) for r in spark.read.parquet(paths[1]).collect())
    assert got == [("p", "q", "r"), ("x", "made_of", "y"), ("x", "made_of", "z")]
    latest = files.recorded(watch.read_manifest(spark, paths[0]).drop("epoch"), spark.createDataFrame([], "path string, hash string, n_triples long, processed_at timestamp"))
    assert latest.count() == 2
    src = files.source_files(spark, str(tmp_path / "raw"))
    assert {r.status for r in files.status(src.select("path", "hash"), latest).collect()} == {"processed"}
    assert files.checked(src, src.select("path", F.sha2("content", 256).alias("sha256"))).where("state = 'ok'").count() == 2


def test_forced_and_full_rebuild(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "a.txt").write_text("x | made_of | y")
    paths = [str(tmp_path / n) for n in ("manifest", "triples")]
    watch.rescan(spark, str(root), build, *paths)
    assert watch.rescan(spark, str(root), build, *paths, force=True) == -2
    assert spark.read.parquet(f"{paths[1]}/epoch=-2").count() == 1
    (root / "a.txt").write_text("x | made_of | z")
    assert watch.rebuild(spark, str(root), build, *paths) == -1
    assert [(r.h, r.u) for r in spark.read.parquet(paths[1]).collect()] == [("x", "z")]


def test_graph_document_is_written_and_read(spark, tmp_path):
    e = spark.createDataFrame([('a "q"', None, None, ["A"], ["t"], [("p.jpg", None, None, 1)], 9, True), ("b", "x", ["x", "y"], None, [], [], 0, False)], "name string, type string, types array<string>, aliases array<string>, text array<string>, img array<struct<path:string,caption:string,source:string,page:int>>, degree long, hub boolean")
    t = spark.createDataFrame([("0", 'a "q"', "r", "b", ["f"]), ("1", "b", "r2", "b", None)], "seq string, h string, r string, u string, sources array<string>")
    files.save_document(files.graph_document(e, t), str(tmp_path / "g"))
    (part,) = (tmp_path / "g").glob("part-*.txt")
    doc = json.loads(part.read_text())
    assert doc["stats"] == {"entities": 2, "relations": 2, "triples": 2, "multimodal_entities": 1, "images": 1, "text_attributes": 1}
    assert doc["entities"]['a "q"']["degree"] == 1 and doc["entities"]["b"]["degree"] == 3 and doc["relations"] == ["r", "r2"]
    e2, t2 = files.read_graph(spark, str(part))
    assert {r.name: r.types for r in e2.collect()} == {'a "q"': None, "b": ["x", "y"]} and t2.count() == 2
    none = files.read_graph(spark, str(tmp_path / "missing.json"))
    assert none[0].count() == none[1].count() == 0


def test_results_splits_and_pages(spark, tmp_path):
    rows = spark.createDataFrame([("q1", True), ("q2", False)], "qid string, correct boolean")
    files.results_document(rows, spark.createDataFrame([(2, 0.5)], "n int, acc double")).write.text(str(tmp_path / "r"))
    got, summary = files.read_results(spark, str(tmp_path / "r"), "qid string, correct boolean", "n int, acc double")
    assert sorted(map(tuple, got.collect())) == [("q1", True), ("q2", False)] and [tuple(r) for r in summary.collect()] == [(2, 0.5)]
    (tmp_path / "split.json").write_text('{"dev": ["a"], "test": ["b", "c"]}')
    assert sorted(r.qid for r in files.split_of(spark, str(tmp_path / "split.json"), "test").collect()) == ["b", "c"]
    (tmp_path / "doc.txt").write_text("one\ftwo")
    (tmp_path / "other.txt").write_text("x")
    src = spark.read.format("binaryFile").load(str(tmp_path / "*.txt"))
    assert sorted(map(tuple, files.page_texts(src, spark.createDataFrame([("doc",)], "stem string")).collect())) == [("doc", 1, "one"), ("doc", 2, "two")]


def test_nearest_perceptual_hash(spark):
    import random

    rng = random.Random(3)
    known = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    rows = [(k & ((1 << 64) - 1)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 14))) for k in known for _ in range(3)]
    rows = [x - (1 << 64) if x >> 63 else x for x in rows]
    got = files.best_matches(spark.createDataFrame(list(enumerate(rows)), "id long, hash long"), spark.createDataFrame(list(enumerate(known)), "match long, hash long"))
    want = {}
    for i, x in enumerate(rows):
        d, m = min(((((x ^ k) & ((1 << 64) - 1)).bit_count()), j) for j, k in enumerate(known))
        if d <= 10:
            want[i] = (m, d)
    assert {r.id: (r.match, r.distance) for r in got.collect()} == want and len(want) > 60


def test_graph_document_round_trip(spark, tmp_path):
    doc = {"meta": {"version": 1}, "entities": {"a": {"name": "a", "aliases": ["A"], "attributes": {"text": ["t"], "img": [{"path": "p.jpg"}]}, "degree": 1}, "b": {"name": "b", "hub": True}}, "relations": ["r"], "triples": [{"h": "a", "r": "r", "u": "b", "sources": ["f"]}, {"h": "b", "r": "r", "u": "a", "sources": []}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    e, t = files.read_graph(spark, str(tmp_path / "g.json"))
    rows = {r.name: r for r in e.collect()}
    assert rows["a"].text == ["t"] and rows["a"].img[0].path == "p.jpg" and rows["b"].hub and not rows["a"].hub
    assert [(r.h, r.u) for r in t.orderBy("seq").collect()] == [("a", "b"), ("b", "a")]
    assert files.read_graph(spark, str(tmp_path / "g.json"), text_only=True)[0].where("size(img) > 0").count() == 0
    files.write_graph(e, t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "relations")).collect()[0].r == "r"
    assert files.export_json(e, t).count() == 4


def test_items_and_manifest(spark, tmp_path):
    item = {"qid": "q1", "type": "chain", "answer_atoms": ["a"], "gold_triples": [{"h": "a", "r": "r", "u": "b"}], "hops": 2}
    for name, value in (("plain", [item]), ("envelope", {"items": [item]})):
        (tmp_path / name).write_text(json.dumps(value))
        assert files.items_of(spark, str(tmp_path / name)).first().gold_triples[0].u == "b"
    (tmp_path / "m.csv").write_text('path,rights,included,source,source_url,source_page,rights_note\np.jpg,third_party,no,x,"http://a,b",,\n')
    assert files.image_manifest(spark, str(tmp_path / "m.csv")).first().source_url == "http://a,b"


def test_notes_have_unique_files(spark):
    t = spark.createDataFrame([("A:b", "r", "a b", "1"), ("a/b", "r", "c", "2")], "h string, r string, u string, seq string")
    got = [r.file for r in pages.notes(t, Steps(spark, "t")).collect()]
    assert len({f.lower() for f in got}) == len(got) == 4
    many = spark.createDataFrame([("hub", "r", f"x{i:03d}", f"{i:03d}") for i in range(500)], "h string, r string, u string, seq string")
    texts = spark.createDataFrame([("hub", 1, "about it")], "entity string, seq long, text string")
    parts = pages.notes(many, Steps(spark, "t"), texts, part=200).where("file = 'hub.md'").orderBy("part").collect()
    whole = "\n".join(r.note for r in parts)
    assert [r.part for r in parts] == [0, 1, 2] and "degree: 500" in whole and whole.count("[[x") == 500 and whole.index("## Text\nabout it\n## Relations") < whole.index("x000")
    assert pages.graphml(t, t.selectExpr("h AS name", "1 AS degree")).count() == 6


def test_only_lines_of_long_notes_are_written(spark):
    steps, written = Steps(spark, "t"), {}

    def keep(df, name):
        written[name] = steps(df, name)
        return written[name]

    t = spark.createDataFrame([("hub", "r", f"x{i:03d}", f"{i:03d}") for i in range(30)] + [("a", "r", "b", "900")], "h string, r string, u string, seq string")
    texts = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("nobody", 1, "no links")], "entity string, seq long, text string")
    got = {(r.file, r.part): r.note for r in pages.notes(t, keep, texts, part=12).collect()}
    assert got["a.md", 0] == "---\nname: a\ndegree: 1\n---\n## Text\none\ntwo\n## Relations\n- r [[b]]" and len(got) == 32 + 3
    assert [got["hub.md", i].count("[[") for i in range(3)] == [11, 12, 7]
    assert {r.name for r in written["note_lines"].collect()} == {"hub"}


def test_providers():
    with pytest.raises(ValueError):
        providers.with_retry(lambda: (_ for _ in ()).throw(ValueError("x")), wait=0)
    judged = providers.canonical(["Kozo", "kozo fiber", "zzz", "Kozo"], ["kozo", "washi"], lambda m, offered: offered[0])
    assert judged["Kozo"] in ("kozo", "Kozo") and judged["zzz"] == "zzz"
    script = iter([{"action": "search", "arg": "x"}, {"action": "expand", "arg": "y", "keep": [0, 5]}, {"action": "finish", "keep": [2, 0]}])
    assert providers.react("q", lambda q, f: next(script), lambda a: ["f0", "f1"], lambda a: ["f1", "f2"]) == ["f0", "f2"]
    assert files.dhash([[9, 8, 7, 6, 5, 4, 3, 2, 1]] * 8) == -1 and files.dhash([[0] * 9] * 8) == 0


def test_failing_provider_is_one_row(spark):
    class Broken:
        def complete(self, prompt, images=None):
            raise RuntimeError("down")

    p = spark.createDataFrame([("f", 1, "x")], "path string, para_no int, text string")
    providers_wait = providers.with_retry.__defaults__
    assert providers_wait == (3, 1.0)
    row = providers.extract(p, Broken).first()
    assert row.error == "RuntimeError: down" and row.h is None


def test_settings_and_thresholds(tmp_path):
    from graphloom.schema import Config, Settings

    (tmp_path / "c.yaml").write_text("# a comment\npaths:\n  output_dir: out  # here\n  graph_file: g.json\nwalk:\n  beam: 5\n  depth: 4\nlists:\n  types:\n  - a\n  - 'b c'\n  flat: [1, 2.5, x]\nhub_degree: 80\nempty:\nflag: true\n")
    got = Settings.load(str(tmp_path / "c.yaml"))
    assert got.get("lists", "types") == ["a", "b c"] and got.get("lists", "flat") == [1, 2.5, "x"] and got.get("flag") is True and got.get("no", "way", default=3) == 3
    assert got.path("graph_file", "x") == str(tmp_path / "out" / "g.json") and got.path("raw_dir", "raw") == str(tmp_path / "raw")
    config = Config.of(got)
    assert (config.beam, config.depth, config.hub_degree, config.text_cap) == (5, 4, 80, 5)
    (tmp_path / "c.json").write_text('{"walk": {"beam": 2}}')
    assert Config.of(Settings.load(str(tmp_path / "c.json"))).beam == 2


def test_a_call_that_is_too_long_sheds_images(spark):
    class Narrow:
        def complete(self, prompt, images=None):
            if len(images or []) > 1:
                raise RuntimeError("maximum context length is 1")
            if prompt == "bad":
                raise ValueError("no")
            return f" {prompt} {images} "

    assert providers.ask(Narrow(), "p", ["a", "b", "c"], wait=0) == (" p ['a'] ", 2)
    rows = spark.createDataFrame([("1", "p", ["a", "b"]), ("2", "bad", None)], "qid string, prompt string, images array<string>")
    got = {r.qid: r for r in providers.answers(rows, Narrow, wait=0.0).collect()}
    assert got["1"].answer == "p ['a']" and got["1"].dropped == 1 and got["1"].error is None
    assert got["2"].error == "ValueError: no" and "generation failed" in got["2"].answer
