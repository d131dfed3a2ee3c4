import mailbox
import random

from helpers import mail, no_projects
from pyspark.sql import functions as F

from listmill.functions import text
from listmill.operators import messages, rows
from listmill.operators.projects import with_project
from listmill.plans import archive, export
from listmill.schemas import COMMIT_EXPORT, COMMITS, EMAIL_EXPORT, MESSAGES, names
from listmill.sources import archives, tables
from listmill.streaming import incremental


def write(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content.encode("latin-1") if isinstance(content, str) else content)


def mbox(*raws):
    return "".join(f"From x@h Mon Feb  3 10:00:00 2003\n{raw}\n\n" for raw in raws)


def test_scan_like_the_standard_library_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "From beta", "\nFrom gamma delta", "\n\n", "From", "\r\n", "\né\n", "\n>From x", "omega\n"]
    raws = [mail("".join(rng.choice(words) for _ in range(rng.randrange(60))), Message_ID=f"<{i}@h>") for i in range(2000)]
    write(tmp_path, "proj/dev/201901.mbox", mbox(*raws).encode())
    box = mailbox.mbox(tmp_path / "proj/dev/201901.mbox")
    wanted = [(m["message-id"], m.get_payload().rstrip("\n")) for m in box]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        mails = archives.read_archives(spark, str(tmp_path))
        assert mails.rdd.getNumPartitions() > 5
        found = mails.transform(messages.with_headers).select(
            *messages.KEYS,
            text.header(F.col("lines"), "message-id").alias("id"),
            F.rtrim(text.after_header(F.col("raw"), F.col("head")), F.lit("\n")).alias("body"),
        ).orderBy("block_start", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    clean = lambda s: s and s.encode("ascii", "ignore").decode()
    got = [(r.id, r.body) for r in found]
    assert [g[0] for g in got] == [w[0] for w in wanted]
    with_id = [(g, w) for g, w in zip(got, wanted) if w[0]]
    assert [(g, w) for g, w in with_id if g[1] != clean(w[1]).rstrip("\n")] == []
    assert {(r.proj_dir, r.folder, r.mbox) for r in found} == {("proj", "dev", "201901.mbox")}


def test_paths_and_excluded_directories(spark, tmp_path):
    for directory in ("asf-wide", "incubator", "attic", "c++ lib", "foo.incubator"):
        write(tmp_path, f"{directory}/dev/1.mbox", mbox(mail()))
    found = archives.read_archives(spark, str(tmp_path))
    assert {r.proj_dir for r in found.collect()} == {"c++ lib", "foo.incubator"}
    cleaned = archives.read_archives(spark, str(tmp_path), archives.NOT_CLEANED)
    assert {r.proj_dir for r in cleaned.collect()} == {"c++ lib", "foo.incubator", "attic"}


def test_cleaned_tree_keeps_keys_order_and_texts(spark, tmp_path):
    raws = [mail(f"b{i} é\nFrom inside\n", Message_ID=f"<{i}@h>") for i in range(300)]
    write(tmp_path, "in/proj/dev/1.mbox", mbox(*raws))
    write(tmp_path, "in/incubator/dev/1.mbox", mbox(mail()))
    archives.clean_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    before = archives.read_archives(spark, str(tmp_path / "in"))
    after = archives.read_archives(spark, str(tmp_path / "out"))
    order = ["proj_dir", "folder", "mbox", "file_path", "block_start", "seq"]
    keys = ["proj_dir", "folder", "mbox", F.rtrim("raw", F.lit("\n"))]
    assert before.orderBy(order).select(*keys).collect() == after.orderBy(order).select(*keys).collect()


def parsed(spark, *raws, **options):
    from helpers import mails

    return archive.parse(mails(spark, *raws), no_projects(spark), **options)


def test_reasons_and_order_of_the_checks(spark):
    found = parsed(
        spark,
        mail(Message_ID=None),
        mail(Message_ID=""),
        mail("", Message_ID="<empty>"),
        mail("second copy", Message_ID="<empty>"),
        mail(Message_ID="<nodate>", Date=None),
        mail(Message_ID="<gmt>", Date="Mon, 3 Feb 2003 10:00:00 GMT"),
        mail(Message_ID="<nobody>", From=None),
        mail("<p>", Message_ID="<html>", Content_Type="text/html"),
        mail(Message_ID="<good>"),
    ).collect()
    assert {r.message_id: r.reject_reason for r in found} == {
        "<empty>": "empty_body", "<nodate>": "bad_date", "<gmt>": "bad_date",
        "<nobody>": "unclassified", "<html>": "empty_body", "<good>": None,
    }
    assert len(found) == 6


def test_foreign_mailers(spark):
    raw = mail(X_Mailer="Outlook")
    assert [r.msg_format for r in parsed(spark, raw).collect()] == ["EMAIL"]
    assert [r.msg_format for r in parsed(spark, raw, strict=True).collect()] == ["SVN"]
    assert [r.msg_format for r in parsed(spark, mail(X_Mailer="Outlook", Subject="svn commit")).collect()] == ["SVN"]


def test_content_is_optional(spark):
    assert [r.content for r in parsed(spark, mail("a\nb\tc")).collect()] == [None]
    assert [r.content for r in parsed(spark, mail("a\nb\tc"), with_content=True).collect()] == ["a;b;c"]


def test_duplicates_one_per_directory_in_a_fixed_order(spark):
    rows = [
        ("foo", "dev", "2.mbox", "f", 0, 1, mail("late")),
        ("foo", "dev", "1.mbox", "f", 9, 0, mail("later split")),
        ("foo", "dev", "1.mbox", "f", 0, 7, mail("first", Subject="kept")),
        ("foo.incubator", "dev", "1.mbox", "f", 0, 0, mail("other directory", Subject="kept too")),
    ]
    schema = "proj_dir string, folder string, mbox string, file_path string, block_start bigint, seq bigint, raw string"
    kept = archive.parse(spark.createDataFrame(rows, schema), no_projects(spark)).collect()
    assert {(r.proj_dir, r.proj_name, r.subject) for r in kept} == {
        ("foo", "foo", "kept"), ("foo.incubator", "foo", "kept too"),
    }


def test_keys_are_unique_and_partitions_do_not_matter(spark):
    from helpers import mails

    rng = random.Random(2)
    raws = [mail(f"Modified: a\n===\n+{i}\n-x\n", Message_ID=f"<{rng.randrange(60)}@h>", X_Mailer="svn") for i in range(300)]
    given = mails(spark, *raws)
    results = []
    for n in (1, 7):
        rows = archive.parse(given.repartition(n), no_projects(spark)).collect()
        assert len({(r.proj_dir, r.message_id) for r in rows}) == len(rows)
        results.append(sorted((r.message_id, r.seq, r.changes[0].addlines) for r in rows))
    assert results[0] == results[1]


def test_one_exchange_with_a_group_limit_below_it(spark, tmp_path):
    from helpers import mails

    path = str(tmp_path / "m")
    mails(spark, mail()).write.parquet(path)
    no_projects(spark).write.parquet(path + "p")
    plan = archive.parse(spark.read.parquet(path), spark.read.parquet(path + "p"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below
    exchanged = below.split("\n")[1]
    assert "raw#" not in exchanged


def test_whole_job_and_exports(spark, tmp_path):
    svn = mail("Author: a\n\nModified: x\n===\n+a\n", Message_ID="<s>", X_Mailer="svnmailer")
    write(tmp_path, "in/foo.incubator/commits/1.mbox", mbox(svn, svn, mail("", Message_ID="<e>")))
    write(tmp_path, "in/foo/dev/1.mbox", mbox(mail(Message_ID="<m>", In_Reply_To="<p>", Subject='a "b", c'), mail(Message_ID="<d>", Date="x")))
    write(tmp_path, "in/123/dev/1.mbox", mbox(mail(Message_ID="<n>")))
    projects = spark.createDataFrame([("foo", "graduated", "2003-01-01")], "alias string, status string, end_date string")
    projects = projects.withColumn("end_date", F.col("end_date").cast("date"))
    out = str(tmp_path / "out")
    counts = archive.run(spark, str(tmp_path / "in"), projects, out)
    # The last mail of a file keeps the line break in front of the end of the file.
    assert counts == {
        "messages": 5, "ignored": 1, "unclassified": 0, "empty": 0, "no_changes": 0, "notices": 1, "emails": 3}
    commits = tables.read_list_tables(spark, f"{out}/commits", COMMITS).collect()
    assert [(r.proj_name, r.folder, r.message_id, r.period, r.status, r.file_path, r.addlines) for r in commits] == [
        ("foo", "commits", "<s>", 1, "graduated", "x", 1)
    ]
    mails = tables.read_list_tables(spark, f"{out}/messages", MESSAGES).collect()
    assert {(r.proj_name, r.message_id, r.period, r.status, r.reference_id) for r in mails} == {
        ("foo", "<m>", 1, "graduated", "<p>"), ("123", "<n>", None, "incubating", None),
        ("foo", "<e>", 1, "graduated", None),
    }
    assert [r.reject_reason for r in spark.read.parquet(f"{out}/rejects").collect()] == ["bad_date"]
    export.run(spark, out, str(tmp_path / "final"))
    finals = spark.read.option("header", True).csv(str(tmp_path / "final/emails"))
    assert finals.columns == EMAIL_EXPORT and finals.count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "final/commits")).columns == COMMIT_EXPORT


def test_nested_directories_replace_equal_files(spark, tmp_path):
    write(tmp_path, "in/foo/dev/1.mbox", mbox(mail(Message_ID="<old>")))
    write(tmp_path, "in/foo/dev/2.mbox", mbox(mail(Message_ID="<kept>")))
    write(tmp_path, "in/incubator/foo-dev/1.mbox", mbox(mail(Message_ID="<new>")))
    write(tmp_path, "in/incubator/a-b-dev/1.mbox", mbox(mail(Message_ID="<other>")))
    write(tmp_path, "in/incubator/general/1.mbox", mbox(mail(Message_ID="<none>")))
    mails = archive.read_with_nested(spark, str(tmp_path / "in"), str(tmp_path / "in/incubator"))
    mails.collect()
    plan = mails._jdf.queryExecution().executedPlan()
    assert "Join" not in plan.toString()
    leaves = plan.collectLeaves()
    assert [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())] == [1, 2]
    rows = archive.parse(mails, no_projects(spark)).collect()
    assert {(r.proj_dir, r.folder, r.message_id) for r in rows} == {
        ("foo", "dev", "<new>"), ("foo", "dev", "<kept>"), ("a-b", "dev", "<other>"),
    }


def test_odd_file_names_survive_both_layouts(spark, tmp_path):
    keys = {("c++ lib", "a:b", "100%.mbox"), ("x=y", "dev", "1+1%20.mbox")}
    for key in keys:
        write(tmp_path, "in/" + "/".join(key), mbox(mail()))
    read = lambda root: {(r.proj_dir, r.folder, r.mbox) for r in archives.read_archives(spark, str(tmp_path / root)).collect()}
    listed = archives.existing_files(spark, str(tmp_path / "in")).collect()
    archives.clean_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert read("in") == read("out") == {tuple(r) for r in listed} == keys


def test_one_id_with_a_third_of_all_mails(spark):
    from helpers import mails

    base = mails(spark, mail("x")).drop("raw", "seq")
    rows = base.crossJoin(spark.range(0, 3000, 1, 8).withColumnRenamed("id", "seq")).withColumn(
        "raw",
        F.concat(F.lit("Message-ID: <"), F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("seq")), F.lit(">\n"),
                 F.lit("From: a@h\nDate: Mon, 3 Feb 2003 10:00:00 +0000\n\nbody")),
    )
    kept = archive.parse(rows, no_projects(spark)).select("message_id", "seq").collect()
    assert len(kept) == 2001 and ("<0>", 0) in {tuple(r) for r in kept}


def test_excluded_directories_are_not_read(spark, tmp_path):
    for directory in ("attic", "incubator", "foo"):
        for month in range(5):
            write(tmp_path, f"{directory}/dev/{month}.mbox", mbox(mail()))
    frame = archives.read_archives(spark, str(tmp_path))
    frame.collect()
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 5


def test_csv_list_tables_keep_texts(spark, tmp_path):
    rows = spark.createDataFrame([("p", "f", 'a "q", \\ z', None), ("p", "f", "plain", 3)], "proj_name string, folder string, subject string, period int")
    tables.write_list_tables(rows, str(tmp_path / "t"), fmt="csv")
    back = tables.read_list_tables(spark, str(tmp_path / "t"), "subject string, period int, proj_name string, folder string", fmt="csv")
    assert {(r.proj_name, r.folder, r.subject, r.period) for r in back.collect()} == {tuple(r) for r in rows.collect()}


def test_pruned_read_reads_nine_columns(spark, tmp_path):
    empty = spark.createDataFrame([tuple([None] * 19)], COMMITS).fillna("x", ["proj_name", "folder"])
    tables.write_list_tables(empty, str(tmp_path / "c"))
    plan = tables.read_list_tables(spark, str(tmp_path / "c"), COMMITS, COMMIT_EXPORT)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):plan.index("Batched")]
    assert "author_email" not in scan and "addlines" in scan
    assert set(COMMIT_EXPORT) <= set(names(COMMITS))


def test_incremental_runs_equal_one_run(spark, tmp_path):
    first = [mail(f"b{i}", Message_ID=f"<{i}@h>") for i in range(10)]
    second = [mail(f"b{i}", Message_ID=f"<{i}@h>") for i in range(5, 15)]
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    sizes = []
    for n, raws in enumerate((first, second, None)):
        if raws:
            write(tmp_path, f"in/proj/dev/{n}.mbox", mbox(*raws))
            write(tmp_path, f"in/attic/dev/{n}.mbox", mbox(*raws))
        incremental.ingest_messages(spark, root, target, files_per_batch=1)
        sizes.append(incremental.stored(spark, target).count())
    assert sizes == [10, 15, 15]
    mailed = rows.email_rows(incremental.stored(spark, target).transform(with_project, no_projects(spark)))
    assert mailed.count() == 15
    once = messages.first_copies(messages.parse_mails(archives.read_archives(spark, root)))
    key = ["proj_dir", "message_id", "mbox", "subject", "message_date", "msg_format"]
    assert set(incremental.stored(spark, target).select(key).collect()) == set(once.select(key).collect())


def test_names_follow_the_class_by_headers(spark):
    """Whatever the subject makes of a mail, its names come from where its headers say."""
    from helpers import SVN_BODY, mails

    jane = "Author: Jane Doe <jane@x.org>\ntext\n"
    given = mails(
        spark,
        mail(SVN_BODY, Message_ID="<plain>", From="dev@x.org", Subject="svn commit: r1"),
        mail("text\n\nAuthor: jdoe\n", Message_ID="<reply>", From="dev@x.org", Subject="Re: r1", X_Mailer="svnmailer"),
        mail("text\n" + jane, Message_ID="<git>", From="Dev <dev@x.org>", Subject="Re: git", X_Git_Rev="1"),
        mail(SVN_BODY, Message_ID="<bare>", From=None, Subject="svn commit: r2"),
    )
    found = {r.message_id: r for r in messages.parse_mails(given).collect()}
    names = {i: (r.msg_format, r.author and r.author.name) for i, r in found.items()}
    assert names == {
        "<plain>": ("SVN", "dev"), "<reply>": ("EMAIL", "jdoe"), "<git>": ("EMAIL", "Jane Doe"), "<bare>": ("SVN", None)}


def test_every_mail_has_a_place(spark, tmp_path):
    """Notices without a change are rejected, not lost; the counts add up."""
    git, svn = {"X_Git_Rev": "1"}, {"Subject": "svn commit: r1"}
    raws = [
        mail(Message_ID="<1>"), mail(Message_ID="<2>", **git), mail(Message_ID="<3>", **svn), mail(Message_ID="<4>", X_Mailer="Outlook"),
        mail(Message_ID="<5>", From=None), mail(Message_ID="<6>", Date="x"), mail("Modified: a\n===\n+x\n", Message_ID="<7>", **svn)]
    write(tmp_path, "in/p/dev/1.mbox", mbox(*raws))
    for strict, emails in ((False, 2), (True, 1)):
        out = str(tmp_path / f"out-{strict}")
        counts = archive.run(spark, str(tmp_path / "in"), no_projects(spark), out, strict=strict)
        assert counts["messages"] == sum(n for k, n in counts.items() if k != "messages") == 7
        assert (counts["emails"], counts["notices"]) == (emails, 1)
        rejects = {r.message_id: r.reject_reason for r in spark.read.parquet(f"{out}/rejects").collect()}
        wanted = {"<2>": "no_changes", "<3>": "no_changes", "<5>": "unclassified", "<6>": "bad_date"}
        assert rejects == wanted | ({"<4>": "no_changes"} if strict else {})


def test_csv_tables_keep_lone_carriage_returns(spark, tmp_path):
    schema = "proj_name string, folder string, subject string, period int"
    given = [("p", "f", s, i) for i, s in enumerate(["x\ry", "\r", "a\r\nb", "a\nb", '"\r"', "\\\r,", "end\r"])]
    frame = spark.createDataFrame(given, schema)
    tables.write_list_tables(frame, str(tmp_path / "t"), fmt="csv")
    back = tables.read_list_tables(spark, str(tmp_path / "t"), "subject string, period int, proj_name string, folder string", fmt="csv")
    assert {(r.proj_name, r.folder, r.subject, r.period) for r in back.collect()} == set(given)
    tables.write_export(frame, str(tmp_path / "e"))
    assert {tuple(r) for r in tables.read_export(spark, str(tmp_path / "e"), schema).collect()} == set(given)


def test_paths_lose_carriage_returns(spark):
    from helpers import mails

    body = "Modified: trunk/x\ry\n===\n+a\n"
    found = messages.parse_mails(mails(spark, mail(body, X_Mailer="svnmailer"))).first()
    assert [c.file_path for c in found.changes] == ["trunk/xy"]


def test_cleaning_takes_nested_directories(spark, tmp_path):
    write(tmp_path, "in/foo/dev/1.mbox", mbox(mail(Message_ID="<old>")))
    write(tmp_path, "in/foo/dev/2.mbox", mbox(mail(Message_ID="<kept>")))
    write(tmp_path, "in/incubator/foo-dev/1.mbox", mbox(mail("é new\n", Message_ID="<new>")))
    write(tmp_path, "in/incubator/general/1.mbox", mbox(mail(Message_ID="<none>")))
    archives.clean_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"), nested_root=str(tmp_path / "in/incubator"))
    rows = messages.parse_mails(archives.read_archives(spark, str(tmp_path / "out"))).collect()
    assert {(r.proj_dir, r.folder, r.mbox, r.message_id) for r in rows} == {
        ("foo", "dev", "1.mbox", "<new>"), ("foo", "dev", "2.mbox", "<kept>")}


def test_a_later_copy_that_comes_first_replaces_the_kept_one(spark, tmp_path):
    """The copy in ``dev`` arrives first, the one in ``commits`` comes first: it replaces it."""
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    for folder in ("dev", "commits"):
        write(tmp_path, f"in/proj/{folder}/1.mbox", mbox(mail(folder, Message_ID="<1@h>")))
        incremental.ingest_messages(spark, root, target)
    assert [r.folder for r in incremental.stored(spark, target).collect()] == ["commits"]
    once = messages.first_copies(messages.parse_mails(archives.read_archives(spark, root)))
    assert [r.folder for r in once.collect()] == ["commits"]


def test_incremental_drops_in_any_order_equal_one_run(spark, tmp_path):
    """A copy that comes first by list, month and place replaces one kept earlier."""
    early = [mail(f"a{i}", Message_ID=f"<{i}@h>") for i in range(6)]
    late = [mail(f"b{i}", Message_ID=f"<{i}@h>") for i in range(3, 9)]
    key = ["proj_dir", "message_id", "folder", "mbox", "subject"]
    results = []
    for order in (("aaa", "zzz"), ("zzz", "aaa")):
        base = tmp_path / "".join(order)
        root, target = str(base / "in"), str(base / "out")
        for name in order:
            raws = early if name == "aaa" else late
            write(base, f"in/proj/{name}/1.mbox", mbox(*raws))
            incremental.ingest_messages(spark, root, target)
        results.append(set(incremental.stored(spark, target).select(key).collect()))
        once = messages.first_copies(messages.parse_mails(archives.read_archives(spark, root)))
        assert results[-1] == set(once.select(key).collect())
    assert results[0] == results[1]
    assert {r.folder for r in results[1] if r.message_id == "<4@h>"} == {"aaa"}


def test_incremental_batches_read_only_their_ids(spark, tmp_path):
    """Ten drops: each keyed-state batch takes the ids of its drop only, not those kept before."""
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(10):
        write(tmp_path, f"in/proj/dev/{n}.mbox", mbox(*[mail(f"b{n}-{i}", Message_ID=f"<{n}-{i}@h>") for i in range(4)]))
        incremental.ingest_messages(spark, root, target)
        assert incremental.stored(spark, target).count() == 4 * (n + 1)
        batch = spark.read.parquet(f"{target}/rows/batch={n}")
        assert batch.count() == 4


def test_incremental_tables_equal_one_run_after_a_replay(spark, tmp_path):
    """Three drops give the commits, messages and rejects of one run over the same files."""
    import os

    from helpers import SVN_BODY
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    drops = [
        [mail(f"b{i}", Message_ID=f"<{i}@h>") for i in range(4)],
        [mail(SVN_BODY, Message_ID="<s1@h>", Subject="svn commit: r1 - trunk/a.txt")] + [mail("x", Message_ID="<1@h>")],
        [mail("", Message_ID="<e@h>")] + [mail(f"c{i}", Message_ID=f"<{i}@h>") for i in range(2, 6)],
    ]
    for n, raws in enumerate(drops):
        write(tmp_path, f"in/proj/dev{2 - n}/1.mbox", mbox(*raws))
        incremental.ingest_messages(spark, root, target, projects=no_projects(spark))
    once = archive.parse(archives.read_archives(spark, root), no_projects(spark))
    want = {
        "commits": rows.commit_rows(once), "messages": rows.email_rows(once), "rejects": rows.reject_rows(once)}

    def tables():
        return {name: incremental.table(spark, target, name) for name in incremental.TABLES}

    for name, got in tables().items():
        assert sorted(map(tuple, got.select(*want[name].columns).collect()), key=str) == sorted(
            map(tuple, want[name].collect()), key=str), name
    assert incremental.counts(spark, target)["messages"] == once.count()
    # The last batch is run again, as after a failure before its commit: nothing changes.
    before = {name: sorted(map(str, frame.collect())) for name, frame in tables().items()}
    commits = tmp_path / "out" / "checkpoint-ids" / "commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if (commits / name).exists():
            os.remove(commits / name)
    incremental.ingest_messages(spark, root, target, projects=no_projects(spark))
    assert {name: sorted(map(str, frame.collect())) for name, frame in tables().items()} == before


def test_incremental_keeps_ids_by_spark_aggregates(spark, tmp_path):
    """No id passes through Python: both keyed states belong to Spark's own aggregation."""
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    write(tmp_path, "in/proj/dev/1.mbox", mbox(mail(Message_ID="<1@h>")))
    incremental.ingest_messages(spark, root, target)
    for checkpoint in ("checkpoint-ids", "checkpoint-kept"):
        state = spark.read.format("state-metadata").load(f"{target}/{checkpoint}")
        assert {r.operatorName for r in state.collect()} == {"stateStoreSave"}


def test_incremental_copies_that_are_replaced_in_turn(spark, tmp_path):
    """Ids whose copies come in falling, rising and mixed order over five drops of one list each."""
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    orders = {"<fall@h>": "edcba", "<rise@h>": "abcde", "<mixed@h>": "cdaeb", "<late@h>": " c b "}
    for n in range(5):
        for folder in "abcde":
            ids = [i for i, order in orders.items() if order[n] == folder]
            if ids:
                write(tmp_path, f"in/proj/{folder}/{n}.mbox", mbox(*[mail(folder, Message_ID=i) for i in ids]))
        incremental.ingest_messages(spark, root, target, projects=no_projects(spark))
        found = sorted((r.message_id, r.folder) for r in incremental.stored(spark, target).collect())
        assert found == sorted((i, min(o[:n + 1].replace(" ", ""))) for i, o in orders.items() if o[:n + 1].strip())
        mailed = incremental.table(spark, target, "messages").select("message_id", "folder").collect()
        assert sorted(map(tuple, mailed)) == found
    gone = spark.read.parquet(f"{target}/retracted").select("message_id", "file_path").distinct().collect()
    assert sorted((r.message_id, r.file_path[-8]) for r in gone) == [
        *[("<fall@h>", f) for f in "bcde"], ("<late@h>", "c"), ("<mixed@h>", "c")]


def test_a_parse_batch_that_is_run_again_keeps_nothing_twice(spark, tmp_path):
    import os

    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        write(tmp_path, f"in/proj/dev/{n}.mbox", mbox(mail(Message_ID=f"<{n}@h>"), mail(Message_ID="<both@h>")))
        incremental.ingest_messages(spark, root, target)
    before = sorted(map(str, incremental.stored(spark, target).drop("batch").collect()))
    for name in ("1", ".1.crc"):
        os.remove(tmp_path / "out" / "checkpoint" / "commits" / name)
    incremental.ingest_messages(spark, root, target)
    assert sorted(map(str, incremental.stored(spark, target).drop("batch").collect())) == before
    assert len(before) == 3
