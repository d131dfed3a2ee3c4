import datetime
import email
import email.utils
import random

from helpers import GIT_BODY, SVN_BODY, apply
from pyspark.sql import functions as F

from listmill.functions import classify, dates, diffs, mime, pages, people, text
from listmill.operators import messages


def changes(spark, function, *bodies):
    return [[tuple(c) for c in found] for found in apply(spark, function, bodies)]


# --- text -------------------------------------------------------------------


def test_non_ascii_is_deleted_like_bytes(spark):
    rng = random.Random(1)
    data = [bytes(rng.randrange(256) for _ in range(60)) for _ in range(200)] + ["é=ü".encode()]
    got = apply(spark, lambda c: text.strip_non_ascii(c.cast("string")), [bytearray(d) for d in data], "binary")
    assert got == [d.translate(None, bytes(range(0x80, 0x100))).decode() for d in data]


def test_cleaning_twice_changes_nothing(spark):
    once = lambda c: text.strip_non_ascii(c)
    values = ["añb", "plain", "", None]
    assert apply(spark, lambda c: once(once(c)), values) == apply(spark, once, values)


def test_headers_like_the_standard_library(spark):
    raws = [
        "SUBJECT: a\n b\nsubject: second\nDate:  x \n\nSubject: body",
        "Received: by h\n\tid 1\nMessage-ID:\n <1@h>\nFrom: \n\n",
        "Subject: no body",
        "not a header\nSubject: x\n\n",
        "Subject: crlf\r\nTo: a@h\r\n\r\nbody",
        "From x@h Mon\nCc: c@h\nX-Mailer:m\n\nb",
    ]
    for name in ("subject", "date", "message-id", "from", "to", "cc", "x-mailer"):
        def value(c, name=name):
            return text.header(text.header_lines(text.header_block(c)), name)
        for raw, got in zip(raws, apply(spark, value, raws)):
            wanted = email.message_from_string(raw)[name]
            if wanted is not None:
                wanted = wanted.replace("\r", "").replace("\n", "").lstrip(" \t")
            assert got == wanted, (raw, name)


def test_body_starts_behind_the_empty_line(spark):
    body = lambda c: text.after_header(c, text.header_block(c))
    raws = ["A: 1\n\nx\n\ny", "A: 1\r\n\r\nx", "A: 1\nno header\n", "A: 1", "\nx"]
    assert apply(spark, body, raws) == ["x\n\ny", "x", "no header\n", "", "x"]


def test_missing_subject_is_null_and_whitespace_is_flattened(spark):
    assert apply(spark, lambda c: text.header(c, "subject"), ["To: a"]) == [None]
    assert apply(spark, text.flatten_whitespace, ["a\nb\tc"]) == ["a;b;c"]


# --- dates ------------------------------------------------------------------


def test_dates(spark):
    cases = {
        "Mon, 3 Feb 2003 10:00:00 -0700 (PDT)": ("Mon, 3 Feb 2003 10:00:00 -0700", (2003, 2, 3, 10)),
        "Mon, 3 Feb 03 10:00:00 +0000": ("3 Feb 2003 10:00:00 +0000", (2003, 2, 3, 10)),
        "3 Feb 03 10:00:00 +0000": ("3 Feb 2003 10:00:00 +0000", (2003, 2, 3, 10)),
        "Mon, 3 Feb 99 10:00:00 +0000": ("3 Feb 2099 10:00:00 +0000", (2099, 2, 3, 10)),
        "Mon, 3 FEBRUARY 2003 10:00:00 +0000": ("Mon, 3 FEBRUARY 2003 10:00:00 +0000", (2003, 2, 3, 10)),
        "Mon, 3 Feb 103 10:00:00 +0000": ("3 Feb 20103 10:00:00 +0000", None),
        "Mon, 31 Feb 2003 10:00:00 +0000": ("Mon, 31 Feb 2003 10:00:00 +0000", None),
        "Mon, 3 Feb 2003 10:00:00 GMT": (None, None),
        "3 Feb 2003 10:00:00": (None, None),
    }
    cleaned = apply(spark, dates.clean_date, list(cases))
    assert cleaned == [c for c, _ in cases.values()]
    moments = apply(spark, dates.wall_clock, cleaned)
    assert moments == [datetime.datetime(*m) if m else None for _, m in cases.values()]
    assert apply(spark, dates.clean_date, [None]) == [None]


def test_wall_clock_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # This hour does not exist in that zone.
        got = apply(spark, dates.wall_clock, ["9 Mar 2003 02:30:00 +0000", "6 Apr 2003 02:30:00 +0000"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [datetime.datetime(2003, 3, 9, 2, 30), datetime.datetime(2003, 4, 6, 2, 30)]


def test_period_truncates_to_zero(spark):
    days = {"1998-01-30": 0, "1998-01-31": 1, "1997-12-31": 0, "1997-12-02": -1, "1997-12-03": 0}
    end = F.lit("1998-01-01").cast("date")
    got = apply(spark, lambda c: dates.period(c.cast("timestamp_ntz"), end), list(days))
    assert got == list(days.values())
    none = F.lit(None).cast("date")
    assert apply(spark, lambda c: dates.period(c.cast("timestamp_ntz"), none), ["1998-01-01"]) == [None]


# --- people -----------------------------------------------------------------


def test_mailboxes_like_the_standard_library(spark):
    values = [
        "Jo Doe <jo@h.org>", '"Doe, Jo" <jo@h.org>', "jo@h.org", "jo@h.org (Jo Doe)", "<jo@h.org>",
        '"Jo \\"X\\" Doe" <jo@h.org>', "Jo   Q. Doe <jo@h.org>", "Jo (work) <jo@h.org>",
    ]
    names = apply(spark, people.mailbox_name, values)
    addresses = apply(spark, people.mailbox_address, values)
    assert list(zip(names, addresses)) == [email.utils.parseaddr(v) for v in values]
    assert apply(spark, people.mailbox_name, [None]) == [None]


def test_authors(spark):
    svn = lambda c: people.svn_author(F.lit(""), F.lit("loc@h"), c)
    assert [tuple(r) for r in apply(spark, svn, ["x\nAuthor: jdoe\n", "x"])] == [("jdoe", "loc@h"), ("loc", "loc@h")]
    raw = "Subject: s\n\n" + GIT_BODY
    assert tuple(apply(spark, people.git_author, [raw])[0]) == ("Jane Doe", "jane@x.example")
    committer = lambda c: people.git_committer(people.git_author(c), F.lit("loc@h"), c)
    got = apply(spark, committer, [raw, raw.replace("Committer", "X"), raw.replace("Author:", "X:")])
    assert [tuple(r) for r in got] == [("John Roe", "john@x.example"), ("loc", "loc@h"), ("loc", "loc@h")]
    assert apply(spark, people.git_author, ["nothing"]) == [None]


# --- classes ----------------------------------------------------------------


def test_classes(spark):
    rows = [
        ("svnmailer", False, "a", "x", "SVN"),
        ("ASF-Git Admin Mailer", True, "a", "x", "Git"),
        (None, True, "a", None, "Git"),
        (None, False, "a", "Re:", "EMAIL"),  # too short to count as a reply, yet a mail
        (None, False, "a", "topic", "EMAIL"),
        ("", False, "", "topic", "EMAIL"),
        ("svnmailer", False, "a", "Re: x", "EMAIL"),
        (None, False, "a", "svn commit: r1", "SVN"),
        (None, False, None, "topic", None),
    ]
    frame = spark.createDataFrame(rows, "x string, g boolean, f string, s string, w string")
    got = frame.select("w", classify.message_class(F.col("s"), F.col("x"), F.col("g"), F.col("f")).alias("r"))
    assert [r.r for r in got.collect()] == [r[4] for r in rows]


# --- diffs ------------------------------------------------------------------


def test_svn_notice(spark):
    assert changes(spark, diffs.svn_changes, SVN_BODY) == [[
        ("trunk/old.txt", "remove", 0, 0),
        ("trunk/dir/", "copy", 0, 0),
        ("trunk/a.py", "mod", 1, 1),
        ("trunk/b.py", "add", 2, 0),
        ("trunk/c.py", "copy", 0, 1),
    ]]


def test_svn_notice_with_other_line_ends_and_without_a_last_one(spark):
    bodies = [SVN_BODY.replace("\n", "\r\n"), SVN_BODY.rstrip("\n"), SVN_BODY + "\n\nmore text\n"]
    wanted = changes(spark, diffs.svn_changes, SVN_BODY)[0]
    assert changes(spark, diffs.svn_changes, *bodies) == [wanted] * 3


def test_svn_section_on_the_first_line_and_without_ruler(spark):
    bodies = ["Modified: a\n+x\n\nAdded: b\n+y\n", "Removed:\n    a\n    b", "nothing", ""]
    assert changes(spark, diffs.svn_changes, *bodies) == [
        [("a", "mod", 2, 0)],  # never closed: the ruler is missing
        [("a", "remove", 0, 0), ("b", "remove", 0, 0)],
        [],
        [],
    ]


def svn_by_lines(body):
    """The section rules stated line by line."""
    rows, current, ruled = [], None, False
    lines = body.split("\n")
    for i, l in enumerate(lines):
        following = lines[i + 1] if i + 1 < len(lines) else ""
        if current:
            if l.startswith("=") and not ruled:
                ruled = True
            elif l == "" and ruled and following[:1].isalpha():
                current = None
            elif l.startswith("+") and not l.startswith("++"):
                current[2] += 1
            elif l.startswith("-") and not l.startswith("--") and current[1] != "add":
                current[3] += 1
            continue
        for word, op in (("Modified: ", "mod"), ("Added: ", "add"), ("Copied: ", "copy")):
            if l.startswith(word):
                name = l[len(word):]
                current, ruled = [name.split(" ")[0] if op == "copy" else name, op, 0, 0], False
                rows.append(current)
    return [tuple(r) for r in rows]


def test_svn_sections_against_the_rules(spark):
    rng = random.Random(7)
    pieces = ["", "", "+a", "-b", "++c", "--d", " e", "===", "Modified: x", "Added: y", "Copied: z (from r1, q)", "word", "1", "+", "-"]
    bodies = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    got = changes(spark, diffs.svn_changes, *bodies)
    assert [b for b, g in zip(bodies, got) if g != svn_by_lines(b)] == []


def test_git_notice(spark):
    renamed = GIT_BODY.replace("+++ b/f.py", "+++ b/h.py").replace("+++ b/g.py", "+++ /dev/null")
    headless = "https://h/a\ndiff --git a/b b/b\nBinary files differ\n\nhttp://h/c\ndiff -u\n--- a/c\r\n+++ b/c\r\n+x\r\n"
    assert changes(spark, diffs.git_changes, GIT_BODY, renamed, headless, "no address\ndiff -\n--- a\n+++ b\n") == [
        [("host.example/repo/f.py", "mod", 1, 2), ("host.example/repo/g.py", "add", 1, 0)],
        [("host.example/repo/f.py", "copy", 1, 2), ("host.example/repo/g.py", "mod", 1, 0)],
        [("h/c", "mod", 1, 0)],
        [],
    ]


def test_git_file_operations(spark):
    frame = spark.createDataFrame(
        [("/f", "/f"), ("dev/null", "/f"), ("/f", "dev/null\r"), ("/f", "/g"), ("/f\r", "/f")], "o string, n string"
    )
    got = [r[0] for r in frame.select(diffs.file_operation(F.col("o"), F.col("n"))).collect()]
    assert got == ["mod", "add", "del", "copy", "mod"]


def test_git_dates_and_revision(spark):
    values = ["\nAuthored: a\nCommit: c\n", "\nAuthored: a\nAuthorDate: b\nX-Git-Rev: x\nCommit: c\n", "\n"]
    assert apply(spark, diffs.git_author_date, values) == ["a", "b", ""]
    assert apply(spark, diffs.git_revision, values) == ["c", "x", ""]
    assert apply(spark, diffs.git_commit_date, ["\nCommitted: d\n", ""]) == ["d", ""]


def test_long_bodies_do_not_overflow_the_stack(spark):
    lines = "\n".join(["+abc"] * 300_000)
    assert changes(spark, diffs.svn_changes, f"Modified: x\n===\n{lines}")[0] == [("x", "mod", 300_000, 0)]
    assert changes(spark, diffs.git_changes, f"http://h/x\ndiff -\n--- a/x\n+++ b/x\n{lines}")[0] == [("h/x", "mod", 300_000, 0)]
    head = "X-A: b\n" * 300_000
    assert len(apply(spark, text.header_block, [head + "\nbody"])[0]) == len(head) + 1


# --- MIME -------------------------------------------------------------------


def stdlib_body(raw):
    leaves = [
        p for p in email.message_from_string(raw).walk()
        if not p.is_multipart() and p.get_content_type() == "text/plain"
    ]
    if not leaves:
        return None
    data = leaves[-1].get_payload(decode=True)
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def bodies(spark, raws):
    frame = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").repartition(8)
    rows = frame.transform(messages.with_headers).transform(messages.with_body).select("i", "body").collect()
    return [r.body for r in sorted(rows)]


def random_leaf(rng):
    import base64
    import quopri

    kind = rng.choice(["text/plain", "TEXT/plain; charset=utf-8", "text/html", None, "application/x", "bogus"])
    said = rng.choice(["héllo = + % wörld\nline two\n", "plain\n\n--x\nboundary=\"b9\"\n--b9\nmore", "", "a=b=3D ==\nq", "café", "--b1 not\nend"])
    encoding = rng.choice([None, "base64", "Quoted-Printable", "8bit"])
    data = said.encode(rng.choice(["utf-8", "latin-1"]))
    if encoding == "base64":
        body = base64.encodebytes(data).decode()
    elif encoding == "Quoted-Printable":
        body = quopri.encodestring(data).decode()
    else:
        body = data.decode("ascii", "ignore")
    head = (f"Content-Type: {kind}\n" if kind else "") + (f"Content-Transfer-Encoding: {encoding}\n" if encoding else "")
    return head + "\n" + body


def random_entity(rng, depth=0):
    way = rng.random()
    if depth < 3 and way < 0.45:
        mark = rng.choice([f"b{depth}", f"=_x.(y)+z{depth}", f"b {depth}"])
        given = f'"{mark}"' if " " in mark or "(" in mark else mark
        out = f"Content-Type: multipart/mixed;{rng.choice([' ', chr(10) + chr(9)])}boundary={given}\n\n{rng.choice(['', 'preamble' + chr(10)])}"
        for _ in range(rng.randrange(4)):
            out += f"--{mark}{rng.choice(['', ' '])}\n{random_entity(rng, depth + 1)}\n"
        return out + (f"--{mark}--{rng.choice(['', chr(10), chr(10) + 'end' + chr(10)])}" if rng.random() < 0.85 else "")
    if depth < 3 and way < 0.52:
        return "Content-Type: message/rfc822\n\nSubject: in\n" + random_entity(rng, depth + 1)
    return random_leaf(rng)


def test_bodies_like_the_standard_library(spark):
    rng = random.Random(5)
    raws = ["Subject: t\nFrom: a@b\n" + random_entity(rng) for _ in range(1500)]
    got = bodies(spark, raws)
    assert [(r, g, stdlib_body(r)) for r, g in zip(raws, got) if g != stdlib_body(r)] == []


def test_odd_base64_never_fails(spark):
    values = ["Y2Fm6Q", "Y2F", "Y", "", "!!Y2Fm==junk", "Y2\nFm\n"]
    got = apply(spark, lambda c: mime.bytes_to_text(mime.from_base64(c)), values)
    assert got == ["café", "ca", "", "", "caf", "caf"]


# --- pages ------------------------------------------------------------------


def test_project_ids_and_states(spark):
    assert apply(spark, pages.project_id, ["amber", "odftoolkit", "other"]) == ["oltu", "odf", "other"]
    assert apply(spark, pages.status_name, [0, 1, 2, 3], "int") == ["incubating", "graduated", "retired", None]


def test_attributes_and_links(spark):
    tag = ["<a href='/x' name=\"n\">t</a>", "<a name=n>t</a>", "<a  HREF=/y>t</a>"]
    assert apply(spark, lambda c: pages.attribute(c, "href"), tag) == ["/x", None, "/y"]
    assert apply(spark, lambda c: pages.attribute(c, "name"), tag) == ["n", "n", None]
    assert apply(spark, pages.link_id, ['<li><a href="https://h/projects/xmlbeans.html">X</a>; revived</li>']) == ["xmlbeans"]
    assert apply(spark, pages.span_ids, ['<span class="l" id="201901">x</span><span>y</span>']) == [["201901"]]


def test_entities(spark):
    import html

    given = [
        "plain", "a &lt;b&gt; &amp;lt; &quot;c&#39;", "Caf&eacute; &#233;&#xE9;&#8217;s &#x1F600;", "&#38;lt; &amp;#39;", "x&nbsp;y",
        "&#0; &#xD800; &#9999999; &bogus; & alone &#; &#x;", "R&amp;D &ndash; <b>bold</b> &uuml;ber", "",
    ]
    got = apply(spark, pages.inner_text, given)
    wanted = [html.unescape(g.replace("<b>", "").replace("</b>", "")) for g in given]
    wanted[5] = given[5]
    assert got == wanted
    assert apply(spark, pages.inner_text, [None]) == [None]


def test_mailbox_parts_equal_parseaddr_on_many_headers(spark):
    """Differential test: 1,000 headers of many forms against the standard library."""
    import random
    from email.utils import parseaddr

    from listmill.functions import people

    rng = random.Random(3)
    atoms = ["Joe", "Doe", "a@x.org", "b@y", '"Q, N"', '"a\\\\"b"', "(c)", "(b (c) d)", "<j@x>", "list:", ";", ",",
             " ", "  ", "é", "<>", "@", ".", "x.y@z", '"', "(", ")", "<", ">"]
    headers = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 6))) for _ in range(1000)] + [None]
    frame = spark.createDataFrame([(h,) for h in headers], "h string")
    got = frame.select("h", people.mailbox_name(F.col("h")).alias("n"), people.mailbox_address(F.col("h")).alias("a"))
    for r in got.collect():
        assert (r["n"], r["a"]) == ((None, None) if r["h"] is None else parseaddr(r["h"])), r["h"]
