from helpers import apply
from pyspark.sql import functions as F

from listmill.operators import catalogue, manifest
from listmill.operators.projects import dimension, with_project
from listmill.plans import catalogue as plan
from listmill.sources import manifest as manifest_io
from listmill.sources import projects as projects_io
from listmill.sources import tables
from listmill.sources.archives import existing_files

PROJECT_PAGE = """<html><body><table>
<tr><th>Project</th><th>Description</th></tr>
<tr id="abc"><td><a href="/projects/abc.html">Abc &amp; Co</a></td><td>intro</td><td>Inc</td><td>m</td><td>2020-01-02</td></tr>
</table><table>
<tr><th>Project</th><th>Description</th></tr>
<tr class="amber"><td><a href="/projects/amber.html">Amber</a></td><td>in
two lines</td><td>Inc</td><td>m</td><td>2010-01-02</td><td>2012-03-04</td></tr>
<tr><th>Project</th></tr>
<tr id="xyz"><td><a href="/projects/xyz.html">Xyz</a></td><td>i</td><td>Inc</td><td>m</td><td>2010-01-02</td><td>2011-01-01</td></tr>
</table></body></html>"""

ATTIC_PAGE = """<html><body><ul><li><a href="https://h/projects/abc.html">not here</a></li></ul>
<h6>Projects in the Attic</h6>
<ul>
  <li><a href="https://h/projects/oltu.html">Oltu</a></li>
  <li><a href="https://h/projects/gone.html">Gone</a>
   ; revived June 2018
  </li>
</ul><ul><li><a href="https://h/projects/xyz.html">neither</a></li></ul></body></html>"""

LIST_PAGE = """<html><a href="/nav">nav</a>
<h3><a name="abc">Abc</a></h3><ul><li><a name="abc">Abc</a> <a href="http://h/abc-dev/">dev</a></li></ul>
<h3>More</h3><ul><li><a href="http://h/abc-commits/">commits</a></li>
<li><a name='xyz'></a><a href='http://h/xyz-dev/'>dev</a></li></ul><a href="/foot">foot</a></html>"""


def page(spark, html):
    return spark.createDataFrame([(html,)], "html string")


def test_projects_with_states_and_attic_flag(spark, tmp_path):
    (tmp_path / "projects.html").write_text(PROJECT_PAGE)
    (tmp_path / "attic.html").write_text(ATTIC_PAGE)
    rows = plan.build_projects(spark, str(tmp_path / "projects.html"), str(tmp_path / "attic.html")).collect()
    got = {r.id: (r.name, r.status, r.sponsor, str(r.start_date), str(r.end_date), r.in_attic, r.intro, r.url) for r in rows}
    site = "http://incubator.apache.org/projects/"
    assert got == {
        "abc": ("Abc & Co", 0, "Inc", "2020-01-02", "None", False, "intro", site + "abc.html"),
        "oltu": ("Amber", 1, "Inc", "2010-01-02", "2012-03-04", True, "in\ntwo lines", site + "amber.html"),
        "xyz": ("Xyz", 2, "Inc", "2010-01-02", "2011-01-01", False, "i", site + "xyz.html"),
    }
    assert {(r.has_dev, r.has_commit) for r in rows} == {(0, 0)}


def test_attic_ids(spark):
    assert [r.id for r in catalogue.attic_ids(page(spark, ATTIC_PAGE)).collect()] == ["oltu", "gone"]


def test_labels_hold_until_the_next(spark):
    rows = catalogue.list_rows(page(spark, LIST_PAGE)).collect()
    assert [tuple(r) for r in rows] == [
        ("abc", "dev", "http://h/abc-dev/"),
        ("abc", "commits", "http://h/abc-commits/"),
        ("xyz", "dev", "http://h/xyz-dev/"),
    ]


def test_manifest_of_months_through_text(spark, tmp_path):
    (tmp_path / "lists.html").write_text(LIST_PAGE)
    index = spark.createDataFrame(
        [("http://h/abc-dev/", '<span id="201901">a</span><span class="x" id="201902">b</span>'), ("http://h/xyz-dev/", "<p>none</p>")],
        "list_url string, html string",
    )
    got = plan.build_manifest(spark, str(tmp_path / "lists.html"), index, str(tmp_path / "manifest"))
    assert {tuple(r) for r in got.collect()} == {
        ("abc", "dev", "http://h/abc-dev/201901.mbox"), ("abc", "dev", "http://h/abc-dev/201902.mbox"),
    }


def test_pending_archives_by_file_listing(spark, tmp_path):
    rows = spark.createDataFrame(
        [("abc", "dev", "http://h,x/1.mbox"), ("abc", "dev", "http://h/2.mbox"), ("xyz", "dev", "http://h/1.mbox")],
        "project string, folder string, url string",
    )
    manifest_io.write_manifest(rows, str(tmp_path / "manifest"))
    (tmp_path / "mbox/abc/dev").mkdir(parents=True)
    (tmp_path / "mbox/abc/dev/1.mbox").write_text("x")
    left = plan.pending_archives(spark, str(tmp_path / "manifest"), str(tmp_path / "mbox"))
    assert {(r.project, r.filename) for r in left.collect()} == {("abc", "2.mbox"), ("xyz", "1.mbox")}
    counts = manifest.progress(manifest_io.read_manifest(spark, str(tmp_path / "manifest")), existing_files(spark, str(tmp_path / "mbox")))
    assert [tuple(r) for r in counts.collect()] == [(3, 1, 2)]


def test_nested_directories(spark):
    nested = spark.createDataFrame(
        [("abc-dev", "1.mbox", "n"), ("x-y-dev", "1.mbox", "n"), ("plain", "1.mbox", "n"), ("abc-dev", "2.mbox", "")],
        "nested_key string, filename string, content string",
    )
    base = spark.createDataFrame([("abc", "dev", "1.mbox", "b"), ("abc", "dev", "3.mbox", "b")], "project string, folder string, filename string, content string")
    merged = manifest.overwrite_union(base, nested.transform(manifest.drop_empty).transform(manifest.split_nested))
    assert {tuple(r) for r in merged.collect()} == {
        ("abc", "dev", "1.mbox", "n"), ("abc", "dev", "3.mbox", "b"), ("x-y", "dev", "1.mbox", "n"),
    }


def test_project_csv_last_alias_wins_and_null_dates(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "listid,listname,pj_alias,status,start_date,end_date\n1,A,a,old,1/1/2000,1/2/2003\n2,A,a,graduated,1/1/2000,12/31/2003\n3,B,b,incubating,1/1/2000,NULL\n4,C,c,,1/1/2000,\n"
    )
    dim = projects_io.read_projects(spark, str(tmp_path / "p.csv"))
    assert {(r.alias, r.status, str(r.end_date)) for r in dim.collect()} == {
        ("a", "graduated", "2003-12-31"), ("b", "incubating", "None"), ("c", None, "None"),
    }
    facts = spark.createDataFrame([("a",), ("c",), ("zzz",)], "proj_name string").withColumn("message_ts", F.lit("2004-02-01").cast("timestamp_ntz"))
    joined = with_project(facts, dim)
    assert {(r.proj_name, r.status, r.period) for r in joined.collect()} == {
        ("a", "graduated", 1), ("c", None, None), ("zzz", "incubating", None),
    }
    # A dimension below the threshold is broadcast without a hint.
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_project_join_without_broadcast(spark):
    dim = spark.createDataFrame([("a", "retired", None)], "alias string, status string, end_date date")
    facts = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("proj_name"), F.lit(None).cast("timestamp_ntz").alias("message_ts"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = with_project(facts, dim).groupBy("status").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {tuple(r) for r in got} == {("retired", 334), ("incubating", 666)}


def test_end_dates_from_json_and_catalogue_dimension(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"a": "1/2/2003",\n "b": "NULL"}')
    assert {(r.alias, str(r.end_date)) for r in projects_io.read_end_dates(spark, str(tmp_path / "e.json")).collect()} == {
        ("a", "2003-01-02"), ("b", "None"),
    }
    rows = catalogue.projects(page(spark, PROJECT_PAGE), page(spark, ATTIC_PAGE))
    assert {(r.alias, r.status, str(r.end_date)) for r in dimension(rows).collect()} == {
        ("abc", "incubating", "None"), ("oltu", "graduated", "2012-03-04"), ("xyz", "retired", "2011-01-01"),
    }


def test_any_date(spark):
    got = apply(spark, projects_io.any_date, ["1/2/2003", "2003-01-02", "NULL", "", None])
    assert [str(d) for d in got] == ["2003-01-02", "2003-01-02", "None", "None", "None"]


def test_preview(spark):
    assert tables.preview(spark.range(20), 5).count() == 5
