"""The queries' inputs: rows derived from the shared tables, and small inline tables for branches that these don't reach; the same for Spark and for SQL.

A derivation is one SELECT that Spark and DuckDB read alike; `given_<table>` stands for a shared table. The inline rows' keys lie below MORE, the derived ones' above.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(literal(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


class Fixture:
    """Rows under a DDL schema of long, int, double, boolean, string and array<string> columns."""

    SQL = {"long": "bigint", "int": "integer", "double": "double", "boolean": "boolean", "string": "varchar", "array<string>": "varchar[]"}

    def __init__(self, schema: str, rows: list[tuple], derived: str = ""):
        self.schema, self.rows, self.derived = schema, rows, derived
        self.columns = [c.split(" ", 1) for c in schema.split(", ")]

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        """The inline rows; with a folder of tables, the derived rows too."""
        inline = spark.createDataFrame(self.rows, self.schema)
        return self.from_tables(spark, sf_dir).unionByName(inline) if sf_dir and self.derived else inline

    def from_tables(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in set(re.findall(r"given_(\w+)", self.derived)):
            spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")).createOrReplaceTempView(f"given_{t}")
        return spark.sql(self.derived).selectExpr(*[f"cast(`{n}` as {k}) as `{n}`" for n, k in self.columns])

    @property
    def inline(self) -> str:
        """The inline rows as a parenthesised SQL query."""
        names = ", ".join(f'"{n}"' for n, _ in self.columns)
        return f"(select {self._cast()} from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in self.rows)}) as v({names}))"

    @property
    def tables(self) -> str:
        """The derived rows as a parenthesised SQL query."""
        return f"(select {self._cast()} from ({re.sub('given_', '', self.derived)}))"

    @property
    def sql(self) -> str:
        return f"(select * from {self.tables} union all select * from {self.inline})" if self.derived else self.inline

    def _cast(self) -> str:
        return ", ".join(f'cast("{n}" as {self.SQL[k]}) as "{n}"' for n, k in self.columns)


def _padded(text: str, n: int) -> str:
    return (text + " lorem ipsum dolor sit amet consectetur" * n)[:n]


_WORDS = "alpha beta gamma delta epsilon zeta theta iota kappa lambda sigma omega quartz violet marble copper silver golden winter summer autumn spring river mountain "

TEXTS = Fixture(
    "doc_id long, text string",
    [
        (900001, None), (900002, ""), (900003, "  \t\n "), (900004, "research university " * 40), (900005, "地理" * 300),
        (900006, "Just a moment... Verifying you are human now. Ray ID 1"),
        (900007, "%PDF-1.4 1 0 obj << /Type /Catalog >> endobj xref trailer startxref %%EOF " + "x" * 60),
        (900008, "An ordinary page that mentions endobj and endstream and /Type once, in a text about file formats and their readers, long enough to count."),
        (900009, "Access denied. You don't have permission to see this page on this server, reference number 18.2f3a."),
        (900010, "Error 404: the page was not found on this server. Please go back to where you came from, or look for it."),
        (900011, "Dear {{name}}, your order ${order} of {$item} is on its way {12} and {{$ctrl.title}} follows, thank you for your patience today."),
        (900012, "Sign in. Log in. Create account. Privacy policy. Terms of service. Cookie settings. All rights reserved. " + _WORDS * 2),
        (900013, "My Jobpage. My Job Cart. My Saved Searches. Refer a friend for this job. " + _WORDS * 3),
        (900014, "Research position at the university. Required Qualifications: a degree. Preferred Qualifications: experience. Minimum qualifications apply. Deadline soon, contact us. " + _WORDS * 12),
        (900015, "a" * 79), (900016, "a b " * 20), (900017, _padded("k", 199)), (900018, _padded("k", 200)), (900019, _padded("k", 499)), (900020, _padded("k", 500)), (900021, _padded("k", 1500)), (900022, _padded("k", 1501)),
        (900023, "aaaaaaaa aaaaaaa aaaaaaaaa bbb aaaaaaaa aaaaaaa aaaaaaaaa bbb aaaaaaaa aaaaaa"),
        (900024, "1234567890 5555 666 777 888 999 000 111 222 333 444 555 666 777 abcdef 888 999 000 111 222"),
        (900025, "!!!! ???? .... ,,,, ;;;; :::: words here and there !!!! ???? .... and some more words to fill the line up"),
        (900026, "tabs\tand\x0bodd\x1cspaces　everywhere in this text of words, and a line\r\nthat ends in the middle of it all"),
        (900027, "control \x01\x02\x03\x04\x05\x06\x07\x08\x01\x02\x03\x04\x05\x06\x07\x08 characters " * 8),
        (900028, "Performing security verification. Enable JavaScript and cookies to continue to the site that you wanted to see, please."),
        (900029, "one two three four-five six--seven _eight- -nine ten. " * 30),
        (900030, "You have been signed out. My referrals. My account options. Job description - essential duties: about the role. " + _WORDS),
    ],
)

RAW_TEXTS = Fixture(
    "doc_id long, text string",
    [
        (910001, None), (910002, ""), (910003, "﻿“Quoted” — it’s here – there… now\xa0then"),
        (910004, "first line\n  12  \nsecond line\nPage 3\nthird\nwww.example.org/x\nfourth\nhttp://example.org\nfifth"),
        (910005, "a hyphen-\nated word and a line\nthat goes on, and\n  more. New\nSentence"),
        (910006, "Good text here.\nLike\n 12 reactions \nReply\nKeep this line\nTo view or add a comment, sign in"),
        (910007, "Body\nSee more comments\nrest that goes\nReport this comment"),
        (910008, "File  Edit View Tools   Help\nThe real text. Sign in JavaScript isn't enabled in your browser. Enable and reload. More text\nTab External Share"),
        (910009, "View Only\nThe position 美 国 人 is open§ to all\nx\nPrint\nZoom In\n\nApply  by ¤mail"),
        (910010, "ab"), (910011, "a \t b\n\n\n\nc   \n  d\xa0"), (910012, "Line one\r\nLine two\rLine three\x0cLine four"),
        (910013, "This browser version is no longer supported, please upgrade to a supported browser. Text stays"),
        (910014, "3 comments\n2 followers\nshare\nI like it\nConnect\n"),
    ],
)

EMAILS = Fixture(
    "id long, email string, name string, text string",
    [
        (1, "yichun.fan[at]duke.edu", "Yichun Fan", "Write to Yichun Fan at yichun.fan[at]duke.edu or info@duke.edu"),
        (2, "contact(at)example.com", "Dr. Jo Lee", "Contact: Dr. Jo Lee, contact(at)example.com"),
        (3, "user [at] domain [dot] com", "User Domain", "user [at] domain [dot] com and Second.One @ uni . ac . uk"),
        (4, "meet at noon", "Ann Noon", "We meet at noon. Verified email at ucy.ac.cy. Email at Example.ORG too"),
        (5, "-", "John Smith", "Contact: Dr. John Smith"), (6, None, "Dr. Jane Doe", "Jane Doe, Ph.D., is here"), (7, "", "-", "nobody"),
        (8, "john@example.com", "John Smith", "Contact: Dr. John Smith <john@example.com>"), (9, "JLEE@x.edu", "Dr. Jo Lee", "jlee@x.edu Professor Jo  Lee"),
        (10, "info@x.edu", "Dr. Jo Lee", None), (11, "xyz@x.edu", "Mary Major", "Associate Professor Mary Major (xyz@x.edu)"), (12, "N/A", "Mary Major", "Mary Major , Professor of maps"),
        (13, "xyz@x.edu", "李 明", "Prof. 李 明"), (14, "Hr@X.org", "Mr. Max Hr", "Max Hr PhD"), (15, "not an address", "Ann (Boss) Lee", "Ann (Boss) Lee, PhD"),
        (16, "a.b@c.de", "A. B", "a.b@c.de; A.B@C.DE; webmaster@c.de email@c.de x at y dot zz"),
    ],
)

NAMES = Fixture(
    "id long, name string, title string, text string",
    [
        (1, 'Assistant Professor Jane "JJ" Doe, PhD', "Dr.", "the page of jane doe"), (2, "Dr. Jo Lee", "Mr.", "J. Lee is here"), (3, "Prof. Dr. Max Muster, Ph.D., Professor", "Ms.", "muster, max"),
        (4, "  Mrs.  Ann   Other ", "", "another text"), (5, "José Núñez (chair) [x]", "Dr.", "josé núñez"), (6, None, "Dr.", "x"), (7, "", None, ""), (8, "Professor", "Dr.", "professor"),
        (9, "Jean-Luc P. Picard; Captain", "Mr./Ms.", "j picard, captain"), (10, "Doctor Who, Dr.", None, "who is the doctor"), (11, "Li", "Ms.", "lithium"), (12, "Ann Lee, Prof., PhD", "Dr.", "lee and a b"),
    ],
)

URLS = Fixture(
    "id long, url string, html string",
    [
        (1, "https://www.netflix.com/j", ""), (2, "https://drive.google.com/file/d/AbC-1_2/view?usp=x", None), (3, "https://drive.google.com/open?id=XyZ9", ""), (4, "https://drive.google.com/uc?id=abc", ""), (5, "https://docs.google.com/document/d/ID1/edit#h", ""),
        (6, "HTTP://A.edu/x.PDF", ""), (7, "https://a.edu/files/x.pdf?download=1", ""), (8, "https://a.edu/x?f=y.pdf", ""), (9, "  https://b.org/p  ", ""), (10, "ftp://b.org/p", ""), (11, "https://", ""), (12, None, None), (13, "", ""), (14, "https://b.org", ""),
        (15, "https://www.linkedin.com/jobs/view/1", ""), (16, "https://www.linkedin.com/in/jo", ""), (17, "https://uni.ac.uk/people/jo", ""), (18, "https://www.bing.com/ck/a?u=x", ""), (19, "https://example.com/~jo/", ""), (20, "https://example.com/", "<a href='https://boards.greenhouse.io/x'>"),
        (21, "https://acme.wd3.myworkdayjobs.com/en-US/Site/job/Berlin/Engineer_JR1", ""), (22, "https://jobs.lever.co/acme/0123456789abcdef-01", ""), (23, "https://fa-x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/300", ""), (24, "https://x.org/CandidateExperience/y", ""), (25, "https://careers.sap.com/x", "<script src='//jobs.SAP.com/a.js'>"),
        (26, "https://x.org/a", "<div data-talentlink-fo-1>"), (27, "https://acme.jobs.personio.de/job/12?x=1", ""), (28, "https://acme.recruitee.com/o/engineer-77", ""), (29, "https://mp.weixin.qq.com/s/1", ""), (30, "https://A.Taleo.net/x", ""), (31, "see https://a.edu/x, now and https://c.org", ""), (32, "https://user@medium.com:80/x", ""), (33, "ref (https://b.edu/y)", ""), (34, "https://x.icims.com/jobs/1", ""), (35, "https://apply.workable.com/acme/j/ABC123DEF/", ""),
    ],
)

REDIRECTS = Fixture(
    "id long, raw string, base string",
    [
        (1, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.edu%2Fp%3Fq%3D1%26r%3D2&rut=abc", "https://duckduckgo.com/html/"), (2, "/l/?rut=https%3A%2F%2Fb.org%2Fx%2By", "https://duckduckgo.com/html/?q=1"), (3, "https://www.bing.com/ck/a?x=1&u=https%253A%252F%252Fc.org", ""), (4, "  https://plain.org/a?b=c ", ""), (5, None, "https://x.org"), (6, "", ""), (7, "/people/jo", "https://uni.edu/search?q=x"), (8, "relative", "https://uni.edu/"), (9, "https://x.org/?u=&uddg=", ""),
    ],
)

FILENAMES = Fixture("id long, name string, kind string", [(1, 'a<b>:"/\\|?*c.pdf', "pdf"), (2, "n" * 120 + ".pdf", "docx"), (3, "n" * 120, "xyz"), (4, "short", None), (5, "a.b." + "c" * 100, "epub"), (6, "n" * 110 + ".", "txt"), (7, "", "rtf")])

SHEET_ROWS = [
    # row_index, Notes, Source, Verifier, Error
    (0, "", "https://a.edu/x", "LLM", ""), (1, "ref (https://b.edu/y)", "", "LLM", "x"), (2, "see https://c.edu/z now", "no link", "", "N"), (3, "https://notes.org", "https://source.org", "", ""), (4, "none", None, None, "bad"),
    (5, None, None, None, None), (6, "https://b.edu", "see https://a.edu/x, now", None, ""), (7, "", "HTTP://A.edu", "", None), (8, "", "https://www.linkedin.com/posts/1", "", ""),
]
SHEET = Fixture("row_index long, Notes string, Source string, Verifier string, Error string", SHEET_ROWS)
UPDATES = Fixture("row_index long, keys array<string>, vals array<string>, verifier string, error string", [(3, ["Notes", "Unknown"], ["new note", "lost"], "LLM", None), (6, ["Source"], [""], "", "partial"), (7, [], [], "LLM", ""), (99, ["Notes"], ["nowhere"], "LLM", "x")])
OUTCOMES = Fixture(
    "id long, found boolean, link string, from_notes boolean, content string, has_results boolean, stage_error string",
    [
        (1, False, None, False, None, False, None), (2, True, None, False, None, False, None), (3, True, "https://a.edu", False, "", False, None), (4, True, "https://www.linkedin.com/x", False, "text", True, ""), (5, True, "https://a.edu", False, "text", True, None), (6, True, "https://a.edu", True, "text", True, ""),
        (7, True, "https://www.linkedin.com/x", True, "text", True, ""), (8, True, "https://a.edu", False, "text", True, "stage 2 failed"), (9, True, "https://x.com/a", False, "text", True, "stage 2 failed"), (10, True, "https://a.edu", False, "text", False, "all failed"), (11, True, "https://github.com/a", False, "text", False, "all failed"), (12, True, "https://a.edu", True, "text", True, "stage 3 failed"),
    ],
)

RECORDS = Fixture(
    "id long, record string",
    [
        (1, '{"Deadline":"2024-13-99x","Number_Places":"up to 12 of 15","Direction":" maps ","University_EN":"U","Contact_Name":"Ann","Contact_Email":"ann[at]u.edu"}'),
        (2, '{"Conference":"1","Number_Places":"3","GIS":"1","Deadline":"Soon"}'),
        (3, '{"Deadline":"May 1","Contact_Name":"-","Contact_Email":"a@b.cd","Workshop":"1","Number_Places":"7"}'),
        (4, '{"Deadline":"2024-05-01","Contact_Name":"-","Contact_Email":"a@b.cd","GIS":" 1 ","RS":"0","PostDoc":"yes"}'),
        (5, '{"GIS":"1","RS":"1","Urban":"1","GNSS":"1"}'), (6, '{"GIS":"1","Other":"1"}'), (7, '{"GIS":"0"}'), (8, '{"Conference":"1"}'), (9, "{}"), (10, None),
        (11, '{"University_CN":"大学","Country_CN":"国","WX_Label1":" ","WX_Label2":"a","WX_Label3":"b","WX_Label4":" c ","WX_Label5":""}'),
        (12, '{"University_CN":"大学","Country_CN":" 国 ","WX_Label1":"遥感","WX_Label2":"","WX_Label3":"","WX_Label4":" d ","WX_Label5":"e"}'),
        (13, '{"GIS":"1","Doctoral Student":"1","Deadline":"","Number_Places":"none","Contact_Email":"-","Contact_Name":"Bo"}'),
    ],
)
STAGES = Fixture(
    "id long, one string, two string, three string, e1 string, e2 string, e3 string",
    [(1, '{"Deadline":"Soon"}', '{"GIS":"1"}', '{"WX_Label1":"x"}', "", "", ""), (2, '{"Deadline":"Soon","Direction":"a"}', None, '{"Direction":"b"}', None, "two failed", None), (3, None, None, None, "one failed", "two failed", "three failed"), (4, None, '{"RS":"1"}', None, "one failed", "", "three failed")],
)
DIRECTIONS = Fixture(
    "id long, found string, mapped string",
    [(1, '{"directions":["deep learning","","climate","maps","more"]}', '{"GIS":"1","RS":1,"Other":"1","Urban":"0"}'), (2, '{"directions":[]}', '{"GIS":"1"}'), (3, "{}", None), (4, '{"directions":["soil"]}', "{}"), (5, None, None), (6, '{"directions":["a \\"b\\""]}', '{"Physical_Geo":"1"}')],
)
DELTAS = Fixture("id long, name string, email string, new_name string, new_email string", [(1, "A", "a@b.c", "Dr. A", "a@b.c"), (2, "A", None, "A", "x@y.z"), (3, "A", "", "A", ""), (4, None, None, "B", "b@c.d"), (5, "A", "a", None, None)])

ATTEMPTS_TEXT = "The research position at the university needs a degree; the deadline is soon. Required qualifications: " + _WORDS * 9
_WEAK = _padded("university research position", 330)
_SHELL = "Just a moment. Verifying you are human. Ray ID 12"
_PDF = "%PDF-1.4 endobj endstream /Type /Catalog " + "z" * 260
ATTEMPTS = Fixture(
    "url string, ord int, method string, content string, transport_challenge boolean, score int",
    [
        ("https://a.org", 0, "http", ATTEMPTS_TEXT, False, 90), ("https://a.org", 1, "playwright", ATTEMPTS_TEXT, False, 90),
        ("https://b.org", 0, "http", _SHELL, False, 0), ("https://b.org", 1, "curl_cffi", _WEAK, False, 50), ("https://b.org", 2, "playwright", ATTEMPTS_TEXT, False, 90), ("https://b.org", 3, "ocr", ATTEMPTS_TEXT, False, 90), ("https://b.org", 4, "browser_agent", ATTEMPTS_TEXT, False, 90),
        ("https://c.taleo.net/x", 0, "http", _WEAK, None, 50), ("https://c.taleo.net/x", 1, "curl_cffi", ATTEMPTS_TEXT, None, 90), ("https://c.taleo.net/x", 4, "browser_agent", _WEAK + "!", None, 50),
        ("https://d.org", 0, "http", _WEAK, False, 50), ("https://d.org", 1, "curl_cffi", _PDF, False, 10), ("https://d.org", 2, "playwright", ATTEMPTS_TEXT, False, 90),
        ("https://e.org", 0, "http", _WEAK, False, 50), ("https://e.org", 2, "playwright", _SHELL, False, 0), ("https://e.org", 3, "ocr", ATTEMPTS_TEXT, False, 90),
        ("https://f.org", 0, "http", None, True, 0), ("https://f.org", 1, "curl_cffi", "", None, 0), ("https://f.org", 4, "browser_agent", None, None, 0),
        ("https://g.org", 0, "http", _WEAK, False, 50), ("https://g.org", 1, "curl_cffi", _WEAK, False, 50), ("https://g.org", 2, "playwright", _SHELL, False, 0), ("https://g.org", 3, "ocr", ATTEMPTS_TEXT, False, 90), ("https://g.org", 4, "browser_agent", _WEAK, False, 50),
        ("https://h.org", 0, "http", None, False, 0),
    ],
)
RETRIES = Fixture("id long, status int, server string, ray string, attempt int", [(1, 403, "cloudflare", None, 0), (2, 403, "nginx", None, 0), (3, 404, None, None, 0), (4, 429, None, None, 0), (5, 500, None, None, 1), (6, 500, None, None, 2), (7, None, None, None, 0), (8, 503, "x", "ray", 1), (9, 503, "Cloudflare-nginx", None, 2), (10, 408, "x", None, 1), (11, 404, "cloudflare", "r", 0)])
ROUTES = Fixture("id long, url string, content_type string, available array<string>", [(1, "https://docs.google.com/document/d/a/edit", "", ["http"]), (2, "https://drive.google.com/file/d/a/view", None, ["playwright", "ocr", "browser_agent"]), (3, "https://jobs.lever.co/a/b", None, ["curl_cffi"]), (4, "https://a.org/x.pdf", None, []), (5, "https://a.org/x", "application/PDF; v=1", ["ocr", "http", "curl_cffi"]), (6, "https://a.org/x", "text/html", ["browser_agent", "playwright"])])
PDF_ATTEMPTS = Fixture("path string, ord int, text string", [("a.pdf", 0, ""), ("a.pdf", 1, "%PDF-1.4 endobj " + "x" * 80), ("a.pdf", 2, ATTEMPTS_TEXT[:200]), ("a.pdf", 3, ATTEMPTS_TEXT), ("b.pdf", 1, "too short"), ("c.pdf", 0, None), ("c.pdf", 4, ATTEMPTS_TEXT[:120])])
CANDIDATES = Fixture(
    "doc_id long, ord int, method string, text string",
    [
        (1, 0, "json-ld", _padded("a", 100)), (1, 1, "trafilatura", _padded("b", 1000)), (2, 0, "og:description", _padded("c", 500)), (2, 1, "innerText", _padded("d", 700)), (3, 0, "soup", _padded("e", 900) + "\nsign in\njoin now\nab\ncd\nlong enough line"), (3, 1, "other", _padded("f", 640)),
        (4, 0, "trafilatura", "Report this comment first"), (4, 1, "innerText", "just a moment"), (5, 0, "resiliparse", _padded("g", 300) + "\nreactions and a reaction\nadd a comment"), (5, 1, "innerText", _padded("h", 1200)), (6, 0, "soup", ""), (6, 1, "soup", None),
    ],
)
RESULTS = Fixture(
    "query_id long, ord int, title string, url string, snippet string",
    [
        (1, 0, "Jo Lee homepage", "https://uni.edu/people/jo", "Professor Jo Lee, jo.lee@uni.edu"), (1, 1, "Jo on X", "https://x.com/jo", "researcher"), (1, 2, "again", "https://uni.edu/people/jo", "other"), (1, 3, "", "", "empty"), (1, 4, "Scholar", "https://scholar.google.com/citations?u=1", "cited by"), (1, 5, "Profile", "https://www.researchgate.net/profile/Jo", "faculty"),
        (1, 6, "LinkedIn", "https://www.linkedin.com/in/jo", "phd"), (1, 7, "Org", "https://a.org/cv", "dr. jo"), (1, 8, None, "https://b.org", None), (1, 9, "KIOS", "https://www.kios.ucy.ac.cy/staff/jo/", "contact"), (1, 10, "z", "https://z.net", ""), (1, 11, "y", "https://y.net", ""), (1, 12, "w", "https://w.net", ""), (1, 13, "v", "https://v.net", ""), (2, 0, "Academia", "https://uni.academia.edu/jo", "scholar"), (2, 1, "Orcid", "https://orcid.org/1", ""),
    ],
)
ANALYSES = Fixture(
    "contact_id long, ord int, contact_name string, has_doctorate boolean, email_address string, gender string",
    [
        (1, 0, "Jo Lee", True, None, "male"), (1, 1, "Jo Lee", True, "info@x.edu", "male"), (1, 2, "Jo Lee", False, "jo.lee[at]x.edu", "unknown"), (2, 0, "Ann Bee", True, "", "male"), (2, 1, "Ann Bee", False, "bee@x.edu", "male"), (3, 0, "Cy Dee", False, "zz@x.edu", "female"), (3, 1, "Cy Dee", False, None, "male"), (3, 2, "Cy Dee", False, None, None), (4, 0, "E F", False, None, "unknown"), (5, 0, "Gi Ha", None, "office@x.edu", "female"),
    ],
)
MODEL_CALLS = Fixture("client string, model string, ord long, ts long, status int", [("c", "m", 0, 0, 401), ("c", "m", 1, 10, 200), ("c", "m", 2, 1799, 200), ("c", "m", 3, 1800, 200), ("c", "m", 4, 1900, 429), ("c", "n", 0, 5, 403), ("c", "n", 1, 6, 403), ("c", "n", 2, 1805, 403), ("c", "n", 3, 1806, 200), ("d", "m", 0, 100, 500), ("d", "m", 1, 101, 200)])
CHAINS = Fixture(
    "client string, ord long, ts long, models array<string>, statuses array<string>",
    [("c", 0, 0, ["a", "b"], ["401", "200"]), ("c", 1, 10, ["a", "b"], ["200", "200"]), ("c", 2, 20, ["a", "b"], ["200", "403"]), ("c", 3, 30, ["a", "b"], ["401", "500"]), ("c", 4, 1820, ["a", "b"], ["200", "200"]), ("c", 5, 1830, ["a", "b"], ["200", "200"]), ("d", 0, 5, ["a"], ["500"]), ("d", 1, 6, ["a"], ["200"])],
)
_HITS = "".join(f'<div class="result"><a class="result__a" href="https://u{i}.edu/">T{i}</a></div>' for i in range(12))
RESULT_PAGES = Fixture(
    "query_id long, provider string, html string, contact string",
    [
        (1, "duckduckgo", """<div id=links><div class="x result web"><h2 class=result__title><a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.edu%2Fp%3Fq%3D1&rut=z"><b>Jo</b> Lee &amp; co</a></h2><a class=result__snippet> a <b>b</b>
 c</a></div><div class="result"><a class="result__a" href=" https://b.org/people/x "><img src=i>Second</a></div><div class=result>no link</div><div class="result"><a class=result__a href="https://www.wikipedia.org/w">W</a></div>
<div class=results><a class=result__a href="https://c.edu/">not in a block</a></div><div class=result><a class=result__a href="https://plain.org/jo">Jo Lee</a><p class=result__snippet>Professor of maps</p></div></div>""", "Dr. Jo Lee"),
        (2, "bing", """<ol><li class="b_algo"><h2><a href="https://uni.ac.uk/">Uni</a></h2><div class=b_snippet>outside</div><div class="b_caption"><p>in caption</p><p>more</p></div></li><li class=b_algo><h2><a href="/staff/1">Staff</a></h2><span class=b_snippet>loose</span></li>
<li class=other><h2><a href="https://d.edu/">no</a></h2></li><li class=b_algo><a href="https://e.edu/">no heading</a></li><li class=b_algo><h2><a href="ftp://f.edu/">no page</a></h2></li></ol>""", "Dr. Jo Lee"),
        (3, "duckduckgo", _HITS, None), (4, "bing", None, "Jo Lee"), (5, "other", _HITS, "Jo Lee"), (6, None, "", None),
    ],
)
PRICE_FEEDS = Fixture(
    "payload string",
    [('{"data":[{"model_name":"a","model_ratio":1.5,"completion_ratio":4,"quota_type":0,"model_price":0,"owner_by":"x","supported_endpoint_types":["openai","gemini"]},{"model_name":"b","quota_type":1,"model_price":0.25}]}',), ('{"models":[{"model_name":"c","model_ratio":2.0,"supported_endpoint_types":[]}]}',), ('{"data":[]}',), ("{}",), (None,)],
)
CATALOGUES = Fixture("id long, generated string, today string", [(1, "2024-05-01 00:00:00", "2024-05-31 23:59:59"), (2, "2024-04-30 23:59:59", "2024-05-01 00:00:00"), (3, "2023-05-10 08:00:00", "2024-05-10 08:00:00"), (4, None, "2024-05-10 08:00:00")])
LOADS = Fixture("page string, ord int, content_hash long, content_length int", [("a", 0, 1, 10), ("a", 1, 2, 20), ("a", 2, 2, 20), ("a", 3, 2, 20), ("a", 4, 2, 20), ("b", 0, 1, 10), ("b", 1, 1, 10), ("b", 2, 1, 11), ("b", 3, 1, 11), ("c", 0, 7, 7), ("c", 1, 7, 7), ("c", 2, 7, 7)])
PRICES = Fixture(
    "model_name string, model_ratio double, completion_ratio double, quota_type int, model_price double, owner_by string, endpoints array<string>",
    [("gpt-4o-mini", 0.075, 4.0, 0, 0.0, "x", ["openai"]), ("text-embedding-3-small", 0.01, None, 0, None, "", ["embeddings", "openai"]), ("mj-draw", 1.0, 1.0, 1, 0.5, "mj", []), ("claude-x", 1.5, 5.0, 0, 0.0, "", ["anthropic", "openai"]), ("models/gemini-pro", 0.625, 8.0, 0, None, None, None), ("kimi-k2", 0.5, 0.0, 0, 0.0, None, ["openai"]), ("other-vl", 0.5, 2.0, None, None, "", []), ("", 1.0, 1.0, 0, 0.0, "", []), ("flat", None, None, 1, 0.0, None, [])],
)
JSON_TEXTS = Fixture(
    "id long, response string",
    [(1, 'Here:\n```json\n{"a":"1"}\n```\nDone'), (2, 'text {"a":1} tail'), (3, 'x {"a":1} y {"b":2} z'), (4, '```\n[1,2]\n```'), (5, '{"a":1,"a":2}'), (6, "nothing"), (7, "[1, 2]"), (8, 'so [ {"a":1} ] it is'), (9, 'Final Answer: {"k":"v"}'), (10, None), (11, ""), (12, "{'a':1}"), (13, '```json\n{bad}\n```\n{"ok":true}')],
)
PAYLOADS = Fixture(
    "id long, payload string",
    [
        (1, '{"choices":[{"message":{"content":"hello"}}]}'), (2, '{"choices":[{"message":{"content":[{"type":"text","text":"he"},{"type":"x"},{"text":"llo"}]}}]}'), (3, '{"choices":[]}'), (4, "{}"),
        (5, '{"output":[{"content":[{"text":"a"},{"type":"x"}]},{"content":[{"text":"b "}]}]}'), (6, '{"candidates":[{"content":{"parts":[{"text":"p"},{"text":"q"}]}},{"content":{}}]}'),
    ],
)
PAGES = Fixture(
    "page_id long, url string, html string",
    [
        (800001, "https://a.org", '<html><head><script type="application/ld+json">{"@type":"NewsArticle","articleBody":"<p>One &amp; two</p><p>three</p>","description":"short"}</script></head></html>'),
        (800002, "https://b.org", '<script type="application/ld+json">[{"description":"first text"},{"description":"other text"},{"articleBody":5}]</script><script type=\'application/ld+json\'>{"@graph":[{"description":"the longest description of all"}]}</script>'),
        (800003, "https://c.org", '<meta property="og:description" content="About&nbsp;us &amp; them"><meta name="description" content="other">'),
        (800004, "https://d.org", "<meta content='Named text' name='description'><script type=\"application/ld+json\">{broken</script>"),
        (800005, "https://e.org", "<p>nothing</p>"), (800006, "https://f.org", None),
        (800007, "https://g.org", '<script type="application/ld+json">{"description":"a<br/>b<script>x</script>"}</script><META CONTENT="Caps" PROPERTY="og:description">'),
    ],
)
FEEDS = Fixture(
    "source string, xml string",
    [
        ("one", "<rss><channel><item><title>PhD in GIS &amp;amp; RS</title><link> https://a.org/1 </link><description>&lt;p&gt;Text &amp;amp; more&lt;/p&gt;</description><pubDate>Mon, 1 Jan 2024</pubDate></item><item><title>No link</title></item><item><title>Second</title><link>https://a.org/2</link></item></channel></rss>"),
        ("two", "<rss><channel><item><title>Only</title><link>https://b.org</link><description>d</description></item></channel></rss>"),
        ("bad", "<rss><channel><item>"),
    ],
)
POSTINGS = Fixture(
    "id long, url string, payload string",
    [
        (1, "https://boards.greenhouse.io/acme/jobs/77", '{"title":"Engineer","company_name":"Acme","location":{"name":"Berlin"},"application_deadline":null,"content":"&lt;p&gt;Build &amp;amp; run&lt;/p&gt;&lt;p&gt;things&lt;/p&gt;"}'),
        (2, "https://jobs.lever.co/acme/0123456789abcdef-01", '[{"text":"Designer","categories":{"location":"Rome","team":"Art"},"lists":[{"text":"You will","content":"<li>draw</li>"},{"text":"","content":""}],"descriptionPlain":"","description":"<b>Join</b> us","additionalPlain":"Bye"}]'),
        (3, "https://acme.wd3.myworkdayjobs.com/en-US/Site/job/Berlin/Engineer_JR1", '{"jobPostingInfo":{"title":"Worker","location":"Oslo","postedOn":"Today","jobDescription":"<p>Do work</p>"}}'),
        (4, "https://jobs.ashbyhq.com/acme/id-2", '{"jobs":[{"id":"id-1","title":"No"},{"id":"id-2","title":"Yes","location":"Remote","employmentType":"FullTime","descriptionHtml":"<div>Hi</div>"}]}'),
        (5, "https://jobs.smartrecruiters.com/Acme/743-title", '{"name":"Clerk","location":{"city":"Bonn","country":"de"},"jobAd":{"sections":{"one":{"title":"About","text":"<p>Us</p>"},"two":{"title":"Role","text":"Work"}}}}'),
        (6, "https://acme.recruitee.com/o/engineer-77", '{"offers":[{"id":77,"slug":"other","title":"By id","city":"Paris"},{"id":1,"slug":"engineer-77","title":"By slug","location":"Lyon","employment_type":"part","description":"<p>D</p>","requirements":"R"}]}'),
        (7, "https://apply.workable.com/acme/j/ABC123DEF/", '{"jobs":[{"shortcode":"ABC123DEF","title":"Cook","location":{"city":"Wien","country":"Austria"},"description":"<p>Cook</p>","benefits":"Food"}]}'),
        (8, "https://acme.jobs.personio.de/job/12?x=1", "<jobs><position><id>11</id><name>No</name></position><position><id>12</id><name>Nurse</name><office>Ulm</office><jobDescriptions><jobDescription><name>Tasks</name><value>&lt;p&gt;Care&lt;/p&gt;</value></jobDescription></jobDescriptions></position></jobs>"),
        (9, "https://acme.bamboohr.com/careers/5", '{"result":{"jobOpening":{"jobOpeningName":"Tester","location":{"city":"Riga","state":null,"country":"LV"},"departmentLabel":"QA","description":"<p>Test</p>"}}}'),
        (10, "https://fa-x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/300", '{"items":[{"Title":"Pilot","PrimaryLocation":"Kiel","ExternalDescriptionStr":"<p>Fly</p>"}]}'),
        (11, "https://acme.teamtailor.com/jobs/9-pilot", '{"items":[{"url":"https://acme.teamtailor.com/jobs/8","title":"No"},{"url":"https://acme.teamtailor.com/jobs/9-x","title":"Baker","content_html":"<p>Bake</p>","_jobposting":{"employmentType":"FULL","jobLocation":{"address":{"addressLocality":"Graz"}}}}]}'),
        (12, "https://acme.eightfold.ai/careers?pid=446", '{"positions":[{"id":445,"name":"First"},{"id":446,"name":"Second","locations":["Nice","Lyon"],"department":"R&D","job_description":"<p>Think</p>"}]}'),
        (13, "https://boards.greenhouse.io/acme", '{"title":"No id"}'), (14, "https://example.org/job/1", "{}"),
    ],
)
LOG_OF_TURNS = 4

#: Added to the ids of derived rows.
MORE = 1_000_000

# What the inline tables' columns are in the shared ones: clients are contacts, pages are search results, fetches and links, orders are rows of the work table,
# parts are records and models, turns of conversations are pages of papers and loads of a page, events are requests.
EMAILS.derived = f"""select {MORE} + client_id as id, case client_id % 6 when 0 then replace(replace(email, '@', '[at]'), '.', '[dot]') when 1 then 'info@' || lower(segment) || '.org' when 2 then replace(email, '@', ' at ') else email end as email,
  case client_id % 4 when 0 then 'Dr. ' || name when 1 then '-' else name end as name, 'Write to ' || case client_id % 3 when 0 then 'Professor ' else '' end || name || ' at ' || email || '. Verified email at ' || lower(segment) || '.example.org, ' || city as text from given_clients"""
NAMES.derived = f"""select {MORE} + client_id as id, case client_id % 5 when 0 then 'Prof. Dr. ' || name || ', PhD' when 1 then 'Dr. ' || name when 2 then name || ' (' || city || ')' when 3 then 'Assistant Professor ' || name else name end as name,
  case client_id % 4 when 0 then 'Dr.' when 1 then 'Ms.' when 2 then '' end as title, 'the page of ' || case client_id % 3 when 0 then name when 1 then lower(name) else segment end as text from given_clients"""
REDIRECTS.derived = f"""select {MORE} + page_id as id, case page_id % 4 when 0 then '/l/?uddg=' || replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '&', '%26') || '&rut=1' when 1 then '//duckduckgo.com/l/?rut=' || replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '&', '%26') when 2 then '/p/' || page_id else url end as raw,
  'https://duckduckgo.com/html/?q=' || page_id as base from given_pages"""
FILENAMES.derived = f"select {MORE} + page_id as id, url || case page_id % 3 when 0 then '.pdf' when 1 then '' else url || '.docx' end as name, case page_id % 4 when 0 then 'pdf' when 1 then 'epub' when 2 then 'xyz' end as kind from given_pages"
SHEET.derived = f"""select {MORE} + o_orderkey as row_index, case o_orderkey % 4 when 0 then 'see https://notes.org/' || o_orderkey || ' first' when 1 then 'no link' when 2 then '' end as Notes, case o_orderkey % 3 when 0 then 'https://uni.edu/jobs/' || o_custkey when 1 then '' end as Source,
  case o_orderstatus when 'F' then 'LLM' when 'O' then '' end as Verifier, case o_orderpriority when '1-URGENT' then 'N' when '2-HIGH' then 'failed' when '3-MEDIUM' then '' end as Error from given_orders"""
UPDATES.derived = f"""select {MORE} + o_orderkey as row_index, split(case o_orderkey % 3 when 0 then 'Notes,Unknown' when 1 then 'Source,Notes' else 'Source' end, ',') as keys, split(case o_orderkey % 3 when 0 then 'note ' || o_custkey || ',lost' when 1 then 'https://new.org,' else '' end, ',') as vals,
  case o_custkey % 2 when 0 then 'LLM' else '' end as verifier, case o_custkey % 3 when 0 then 'partial' when 1 then '' end as error from given_orders where o_orderstatus = 'P'"""
OUTCOMES.derived = f"""select {MORE} + page_id as id, page_id % 11 <> 0 as found, case when page_id % 7 <> 0 then case page_id % 5 when 0 then 'https://www.linkedin.com/' || page_id else url end end as link, page_id % 3 = 0 as from_notes, case when page_id % 13 <> 0 then html end as content, page_id % 4 <> 0 as has_results,
  case page_id % 6 when 0 then 'stage 2 failed' when 1 then '' end as stage_error from given_pages"""
RECORDS.derived = f"""select {MORE} + p_partkey as id, case p_size % 5 when 0 then '{{"GIS":"1","RS":"' || (p_partkey % 2) || '"}}' when 1 then '{{"WX_Label1":"' || p_name || '"}}'
  else '{{"Deadline":"' || case p_partkey % 4 when 0 then 'Soon' when 1 then '2024-05-01' when 2 then '2024-05-01 noon' else 'later' end || '","Number_Places":"up to ' || p_size || ' of ' || p_partkey || '","Direction":" ' || p_name || ' ","University_EN":"' || p_brand || '","Contact_Name":"' || case p_partkey % 3 when 0 then '-' else p_name end || '","Contact_Email":"' || replace(p_name, ' ', '.') || '[at]uni.edu","GIS":"' || (p_partkey % 2) || '","Conference":"' || (p_partkey % 7) || '"}}' end as record from given_part"""
STAGES.derived = f"""select {MORE} + p_partkey as id, case when p_size % 4 <> 0 then '{{"Deadline":"Soon","Direction":"' || p_name || '"}}' end as one, case when p_size % 3 <> 0 then '{{"GIS":"1","RS":"1"}}' end as two, case when p_size % 5 <> 0 then '{{"WX_Label1":"' || p_type || '","Direction":"' || p_brand || '"}}' end as three,
  case when p_size % 4 = 0 then 'one failed' else '' end as e1, case when p_size % 3 = 0 then 'two failed' end as e2, case when p_size % 5 = 0 then 'three failed' end as e3 from given_part"""
DIRECTIONS.derived = f"""select {MORE} + p_partkey as id, case p_size % 4 when 0 then '{{"directions":[]}}' else '{{"directions":["' || p_name || '","","' || p_type || '","' || p_brand || '","more"]}}' end as found, '{{"GIS":"' || (p_size % 2) || '","RS":"1","Other":"1","Urban":"' || (p_partkey % 3) || '"}}' as mapped from given_part"""
DELTAS.derived = f"select {MORE} + client_id as id, name, email, case client_id % 3 when 0 then 'Dr. ' || name when 1 then name end as new_name, case client_id % 4 when 0 then lower(segment) || '@x.org' when 1 then '' else email end as new_email from given_clients"
ATTEMPTS.derived = """select url || '#' || page_id as url, 0 as ord, 'http' as method, case page_id % 3 when 0 then '' else html end as content, false as transport_challenge, page_id * 37 % 100 as score from given_pages
  union all select url || '#' || page_id, 1, 'playwright', case page_id % 5 when 0 then null else html end, false, page_id * 53 % 100 from given_pages union all select url || '#' || page_id, 2, 'browser_agent', html, true, 40 from given_pages"""
RETRIES.derived = f"""select {MORE} + event_id as id, case event_type when 'error' then 403 when 'click' then 429 when 'purchase' then 500 when 'view' then 404 else 503 end as status, case user_id % 3 when 0 then 'cloudflare' when 1 then 'nginx' end as server, case user_id % 5 when 0 then 'ray-' || user_id end as ray, event_id % 3 as attempt from given_events"""
ROUTES.derived = f"""select {MORE} + page_id as id, case page_id % 6 when 0 then 'https://docs.google.com/document/d/' || page_id || '/edit' when 1 then 'https://drive.google.com/file/d/' || page_id || '/view' when 2 then 'https://jobs.lever.co/acme/' || page_id when 3 then url || '/x.pdf' else url end as url,
  case page_id % 4 when 0 then 'text/html' when 1 then 'application/pdf' else '' end as content_type, split(case page_id % 3 when 0 then 'curl_cffi,ocr' when 1 then 'playwright' else 'browser_agent,curl_cffi,playwright' end, ',') as available from given_pages"""
PDF_ATTEMPTS.derived = "select 'd' || doc_id as path, 0 as ord, case when doc_id % 2 = 0 then '%PDF-1.4 ' || text end as text from given_documents union all select 'd' || doc_id, 1, text from given_documents"
RESULTS.derived = f"""select {MORE} + page_id % 97 as query_id, page_id as ord, case page_id % 3 when 0 then 'Jo Lee homepage' when 1 then 'People of the university' else 'Results' end as title, case page_id % 10 when 0 then '' when 1 then 'https://uni.edu/people/' || (page_id % 7) when 2 then 'https://x.com/p' || page_id else url end as url,
  case page_id % 4 when 0 then 'Professor Jo Lee, jo.lee@uni.edu' when 1 then 'J. Lee, researcher' else url end as snippet from given_pages"""
ANALYSES.derived = f"""select {MORE} + c_nationkey as contact_id, c_custkey as ord, 'Jo Lee' as contact_name, c_acctbal > 3000 as has_doctorate, case c_custkey % 4 when 0 then 'info@x.edu' when 1 then 'jo.lee' || c_custkey || '[at]x.edu' when 2 then 'someone@x.edu' end as email_address,
  case c_mktsegment when 'HOUSEHOLD' then 'male' when 'MACHINERY' then 'female' when 'BUILDING' then 'unknown' when 'FURNITURE' then '' end as gender from given_customer"""
PRICES.derived = """select case p_size % 6 when 0 then 'gpt-4o-' when 1 then 'claude-' when 2 then 'models/gemini-' when 3 then 'text-embedding-' when 4 then 'qwen-vl-' else 'other-' end || p_partkey as model_name, p_size * 0.125 as model_ratio, case p_partkey % 3 when 0 then 4.0 when 1 then 0.0 end as completion_ratio,
  case p_partkey % 9 when 0 then 1 else 0 end as quota_type, case p_partkey % 2 when 0 then 0.25 end as model_price, lower(p_brand) as owner_by, split(case p_partkey % 4 when 0 then 'openai' when 1 then 'anthropic,openai' else 'embeddings' end, ',') as endpoints from given_part"""
PRICE_FEEDS.derived = """select case p_size % 2 when 0 then '{"data":[' else '{"models":[' end || '{"model_name":"' || p_name || '-' || p_partkey || '","model_ratio":' || (p_size % 4) || '.5,"completion_ratio":' || (p_partkey % 5) || ',"quota_type":' || (p_partkey % 2) || ',"model_price":0.25,"owner_by":"' || p_brand || '","supported_endpoint_types":["openai","' || lower(p_type) || '"]},{"model_name":"' || p_type || '"}]}' as payload from given_part"""
CATALOGUES.derived = f"select {MORE} + o_orderkey as id, left(cast(o_orderdate as string), 10) || ' 10:00:00' as generated, case o_orderkey % 3 when 0 then left(cast(o_orderdate as string), 7) || '-28 23:59:59' when 1 then '2024-05-01 00:00:00' else left(cast(o_orderdate as string), 5) || '01-15 00:00:00' end as today from given_orders"
LOADS.derived = "select 'c' || conv_id as page, turn as ord, length(role) as content_hash, case when turn < 2 then length(text) else 100 end as content_length from given_conversations"
JSON_TEXTS.derived = f"""select {MORE} + conv_id * 1000 + turn as id, case turn % 4 when 0 then 'Here:' || chr(10) || '```json' || chr(10) || '{{"role":"' || role || '"}}' || chr(10) || '```' || chr(10) || said when 1 then said || ' {{"role":"' || role || '"}} ' || said when 2 then said when 3 then '[{{"role":"' || role || '"}}]' end as response
  from (select conv_id, turn, role, translate(coalesce(text, ''), '{{}}[]`"', '      ') as said from given_conversations)"""
PAYLOADS.derived = f"""select {MORE} + conv_id * 1000 + turn as id, case turn % 4 when 0 then '{{"choices":[{{"message":{{"content":"' || role || ' ' || n || '"}}}}]}}' when 1 then '{{"choices":[{{"message":{{"content":[{{"type":"text","text":"' || role || '"}},{{"type":"x"}},{{"text":" ' || n || '"}}]}}}}]}}'
  when 2 then '{{"output":[{{"content":[{{"text":"' || role || ' ' || n || '"}}]}}]}}' else '{{"candidates":[{{"content":{{"parts":[{{"text":"' || role || ' ' || n || '"}}]}}}}]}}' end as payload from (select conv_id, turn, role, coalesce(length(text), 0) as n from given_conversations)"""
FEEDS.derived = """select 'd' || page_id as source, '<rss><channel><item><title>Page ' || page_id || ' &amp;amp; more</title><link> https://a.org/' || page_id || ' </link><description>&lt;p&gt;On ' || (page_id % 7) || '&lt;/p&gt;</description><pubDate>Mon, 1 Jan 2024</pubDate></item><item><title>No link</title></item></channel></rss>' as xml from given_pages"""
RESULT_PAGES.derived = f"""select {MORE} + page_id as query_id, case page_id % 2 when 0 then 'duckduckgo' else 'bing' end as provider, case page_id % 2 when 0 then '<div class="result"><a class="result__a" href="https://u' || page_id || '.edu/">T <b>' || page_id || '</b></a></div>' else '<ol><li class="b_algo"><h2><a href="https://v' || page_id || '.edu/">V' || page_id || '</a></h2><div class="b_caption"><p>said</p></div></li></ol>' end as html, '' as contact from given_pages"""
POSTINGS.derived = f"""select {MORE} + p_partkey as id, 'https://boards.greenhouse.io/acme/jobs/' || p_partkey as url, '{{"title":"' || p_name || '","company_name":"' || p_brand || '","location":{{"name":"' || p_type || '"}},"application_deadline":null,"content":"&lt;p&gt;Build &amp;amp; run&lt;/p&gt;&lt;p&gt;size ' || p_size || '&lt;/p&gt;"}}' as payload from given_part"""
