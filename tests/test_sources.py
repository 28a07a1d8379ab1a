"""Readers and writers on files of our own."""

from pyspark.sql import functions as F

from quire.plans import fixtures
from quire.sources import pages, readers, triples, writers


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "editions.csv").write_text("title, anno_id, iiif_manifest\nA, abc, http://x\n")
    assert tuple(readers.csv_strings(spark, f"{tmp_path}/editions.csv").first()) == ("A", "abc", "http://x")
    assert readers.csv(spark, f"{tmp_path}/editions.csv", readers.EDITIONS).first()["iiif_manifest"] == "http://x"
    (tmp_path / "ids.txt").write_text(" a \n\n# no\nb\n")
    assert [r["line"] for r in readers.lines(spark, f"{tmp_path}/ids.txt").collect()] == ["a", "b"]
    (tmp_path / "corpus.txt").write_text("one | two||\n|\n")
    assert [r["parts"] for r in readers.corpus_lines(spark, f"{tmp_path}/corpus.txt").collect()] == [["one", "two"]]
    (tmp_path / "work.tsv").write_text("p1\thttp://x\n")
    assert tuple(readers.work_list(spark, f"{tmp_path}/work.tsv").first()) == ("p1", "http://x")
    (tmp_path / "rows.jsonl").write_text('{"id":"a","text":"t"}\n\n{"id":"b"}\n')
    assert readers.json_lines(spark, f"{tmp_path}/rows.jsonl", readers.DIGESTS).count() == 2
    (tmp_path / "entries.json").write_text('[{"id":"e1","entry":"x"},{"id":"e2"}]')
    assert [r["id"] for r in readers.json_documents(spark, f"{tmp_path}/entries.json", readers.ENTRIES).collect()] == ["e1", "e2"]


def test_texts_and_missing_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.xml").write_text("<x/>")
    found = readers.whole_texts(spark, str(tmp_path), "*.txt").withColumn("path", F.substring_index("path", "/", -1))
    wanted = spark.createDataFrame([("a.txt",), ("z.txt",)], "path string")
    assert {tuple(r) for r in readers.listed_texts(wanted, found).collect()} == {("a.txt", "one\ntwo", False), ("z.txt", "", True)}
    assert readers.files(spark, str(tmp_path), "*.xml").first()["length"] == 4


def test_writers_and_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "1905", "p1", 1), ("a", "1906", "p2", 2), ("b", "1905", "p3", 3)], "short_title string, year string, page string, n int")
    writers.work_lists(df, f"{tmp_path}/lists", ["short_title", "year"])
    assert (tmp_path / "lists" / "short_title=a" / "year=1906").is_dir()
    writers.csv(df, f"{tmp_path}/csv")
    writers.json_lines(df, f"{tmp_path}/json")
    writers.parquet(df, f"{tmp_path}/pq", ["year"])
    writers.xml(df, f"{tmp_path}/xml", "rows", "row")
    writers.text_lines(df, f"{tmp_path}/txt", "page")
    writers.appended_log(df, f"{tmp_path}/log")
    writers.appended_log(df, f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == spark.read.json(f"{tmp_path}/json").count() == spark.read.parquet(f"{tmp_path}/pq").count() == 3
    assert spark.read.format("xml").option("rowTag", "row").load(f"{tmp_path}/xml").count() == 3 and spark.read.text(f"{tmp_path}/log").count() == 6
    assert writers.joined_text(df.repartition(3), "n", "page").first()["page"] == "p1\n\np2\n\np3"
    assert writers.keyed_json(df, "page", "n").first()["json"] == '{"p1":1,"p2":2,"p3":3}'
    assert writers.markdown(df.orderBy("n").select("page", "n")).splitlines()[2] == "| p1 | 1 |"


def test_generated_pages_are_read_again(spark):
    lines = F.array(F.struct(F.lit("l1").alias("id"), F.lit("0,0 1,1").alias("points"), F.lit("0,1 1,1").alias("baseline"), F.lit("a & <b>").alias("text")))
    xml = spark.range(1).select(F.lit("/x/p.xml").alias("path"), pages.page_xml(F.lit("p.jpg"), F.lit(800), F.lit(600), lines).alias("text"))
    assert pages.text_regions(xml).first()["text"] == "a & <b>"
    url = xml.select(pages.with_image_urls(F.col("text"), F.lit("http://h/i$1.jpg")).alias("t")).first()["t"]
    assert 'imageFilename="http://h/i$1.jpg"' in url


def test_seeded_choice_without_choices(spark):
    items, none = spark.range(3).withColumnRenamed("id", "i"), spark.createDataFrame([], "ordinal long, c string")
    assert [r["c"] for r in readers.seeded_choice(items, none, 1, "i", "c").collect()] == [None] * 3


def test_triples_of_blank_and_typed_nodes(spark):
    xml = fixtures.GRAPHS[0][1].replace("</rdf:RDF>", '<bk:Transaction rdf:about="urn:t#T3"><bk:x><bk:Money><bk:unit>d</bk:unit></bk:Money></bk:x><bk:y rdf:parseType="Resource"><bk:z>1</bk:z></bk:y></bk:Transaction></rdf:RDF>')
    rows = triples.triples(spark.createDataFrame([("g", xml)], "graph string, text string")).where("s = 'urn:t#T3' AND o_kind = 'bnode'").count()
    assert rows == 2


def test_options_take_the_types_of_their_defaults(spark):
    from quire.session import options

    defaults = {"generation.model": "echo", "run.max_retries": 3, "generation.temperature": 0.0, "run.fail": False, "paths.output": None}
    for key, value in {"generation.model": "other", "run.max_retries": "5", "run.fail": "true", "paths.output": "/out"}.items():
        spark.conf.set(f"quire.{key}", value)
    assert options(spark, defaults) == {"generation.model": "other", "run.max_retries": 5, "generation.temperature": 0.0, "run.fail": True, "paths.output": "/out"}


def test_texts_of_lines_are_edited_in_place(spark):
    line = '<TextLine id="a" custom="x"><Coords points="1,1"/><Word id="w"><TextEquiv><Unicode>word</Unicode></TextEquiv></Word><TextEquiv conf="0.1"><Unicode>old</Unicode></TextEquiv>\n<TextEquiv/><TextStyle bold="true"/></TextLine>'
    other = "<pc:TextLine id='b'><pc:TextEquiv><pc:Unicode>old</pc:Unicode></pc:TextEquiv></pc:TextLine>"
    page = f'<?xml version="1.0"?>\n<Page>é{line}\n<TextRegion><TextEquiv><Unicode>region</Unicode></TextEquiv>{other}<TextLine id="c"/><TextLine id="d" /> <TextLineX/></TextRegion></Page>\n'
    df = spark.createDataFrame([("p", page, 1), ("q", page, 2), (None, page, 3), ("r", None, 4)], "path string, text string, n int")
    new = [("p", "a", "a & <b> $1", 0.5), ("p", "b", "", None), ("p", "b", None, None), ("p", "c", "new", None), ("p", "zz", "lost", None), ("p", None, "x", None), ("r", "a", "x", None)]
    got = {r["n"]: r["text"] for r in pages.with_line_texts(df, spark.createDataFrame(new, "path string, line_id string, text string, conf double")).collect()}
    want = page.replace('<TextEquiv conf="0.1"><Unicode>old</Unicode></TextEquiv>\n<TextEquiv/><TextStyle', '\n<TextEquiv conf="0.5"><Unicode>a &amp; &lt;b&gt; $1</Unicode></TextEquiv><TextStyle')
    want = want.replace("<pc:TextEquiv><pc:Unicode>old</pc:Unicode></pc:TextEquiv>", "").replace('<TextLine id="c"/>', '<TextLine id="c"><TextEquiv><Unicode>new</Unicode></TextEquiv></TextLine>')
    assert got == {1: want, 2: page, 3: page, 4: None}


def test_pages_come_in_small_batches_and_are_parsed_once(spark):
    from quire.plans import pipelines

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.createDataFrame([("/in/a/1905/p.xml", "<PcGts><Page/></PcGts>")], "path string, text string")
    out = pipelines.newspaper(docs, lambda: lambda b: b.assign(post_corrected=b["chunk"]))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInPandas") + plan.count("MapInArrow") == 1  # the model's
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"


def test_functions_of_texts_and_graphs_take_small_batches(spark):
    from pyspark.sql import functions as F
    from quire.functions import chunks
    from quire.sources import triples

    kept = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for use in (lambda: chunks.chunk_bytes(F.col("t")), lambda: triples.triples(spark.createDataFrame([], "graph string, text string"))):
        spark.conf.set(kept, "10000")
        use()
        assert spark.conf.get(kept) == "512"


def test_lines_end_where_a_tag_of_theirs_closes(spark):
    from pyspark.sql import functions as F
    from quire.sources import pages

    assert "(?<=TextLine>)(?:" in pages._BESIDE_LINES
    rows = spark.createDataFrame([('<p:TextLine id="a">x</p:TextLine>TextLine><TextLine id="b"/>',)], "t string")
    assert rows.select(F.split("t", pages._BESIDE_LINES)).first()[0] == ['<p:TextLine id="a">x</p:TextLine>', "TextLine>", '<TextLine id="b"/>']


def test_tags_are_found_once(spark):
    from pyspark.sql import functions as F
    from quire.functions import answers

    rows = spark.createDataFrame([("<p>a</p><closer/><p/>",), ("<p>",), (None,)], "t string").select(answers.tag_counts(F.col("t")).alias("n"))
    assert [r["n"] for r in rows.collect()] == ["p:2 closer:1", "", ""]
    assert "transform(array(regexp_extract_all" in rows._jdf.queryExecution().optimizedPlan().toString()
