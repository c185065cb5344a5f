"""E-mail threads made from the conversations table, by one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each conversation the last turn is the message; the turn before is quoted below it, under one of four headers, with signatures and disclaimers by number.
THREADS_SQL = """
SELECT conv_id, concat(body, CASE WHEN sig = 1 THEN concat(chr(10), chr(10), 'Best regards,', chr(10), 'Ann Example') WHEN sig = 2 THEN concat(chr(10), '-- ', chr(10), 'Bob Example', chr(10), 'Tel: +1 555 0100', chr(10))
  WHEN sig = 3 THEN concat(chr(10), chr(10), 'Sent from my iPhone') WHEN sig = 4 THEN concat(chr(10), 'Thanks,', chr(10), 'Carol', chr(10)) ELSE '' END,
  CASE WHEN legal = 1 THEN concat(chr(10), chr(10), 'CONFIDENTIALITY NOTICE: this message is for its reader only.', chr(10), chr(10)) WHEN legal = 2 THEN concat(chr(10), chr(10), '--------------------', chr(10), 'Disclaimer', chr(10), 'No offer is made.', chr(10)) ELSE '' END,
  CASE WHEN head = 0 THEN concat(chr(10), chr(10), 'On Mon, 3 Mar 2025 at 10:00, Dan wrote:', chr(10), '> ', replace(quoted, chr(10), concat(chr(10), '> ')), chr(10))
  WHEN head = 1 THEN concat(chr(10), chr(10), 'From: Dan', chr(10), 'Sent: Monday', chr(10), 'To: Ann', chr(10), 'Subject: Plans', chr(10), quoted)
  WHEN head = 2 THEN concat(chr(10), chr(10), '-----Original Message-----', chr(10), quoted) ELSE '' END) AS content
FROM (SELECT conv_id, coalesce(text, '') AS body, coalesce(quoted, '') AS quoted, conv_id % 4 AS head, conv_id % 5 AS sig, conv_id % 3 AS legal FROM (
  SELECT conv_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS quoted, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS n FROM conversations) t WHERE n = 1) u
"""


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and content."""
    return spark.sql(THREADS_SQL.replace("FROM conversations)", "FROM {conversations})"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def as_eml(content):
    """A column of plain bodies as multipart .eml sources."""
    head = "From: a@example.org\nTo: b@example.org\nSubject: x\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=\"cut\"\n\n--cut\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"
    return F.concat(F.lit(head), content, F.lit("\n--cut--\n"))


def as_eml_bytes(content, number):
    """Bodies as .eml bytes in four shapes by number: base64 inside nested multiparts, ISO-8859-1 (what it lacks as ?), quoted-printable, two plain parts."""
    utf8, hexed = F.encode(content, "UTF-8"), F.hex(F.encode(content, "UTF-8"))
    put = lambda text: F.encode(F.lit(text), "UTF-8")
    nested = F.concat(
        put("MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=out\n\n--out\nContent-Type: multipart/alternative; boundary=in\n\n--in\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
        F.encode(F.base64(utf8), "UTF-8"), put("\n--in--\n--out\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nAAECAw==\n--out--\n"),
    )
    latin = F.concat(put("MIME-Version: 1.0\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\n"), F.encode(F.regexp_replace(content, r"[^\x00-\xff]", "?"), "ISO-8859-1"))
    quoted = F.concat(put("MIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"), F.encode(F.regexp_replace(hexed, "(..)", "=$1"), "UTF-8"))
    two = F.concat(put("MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=cut\n\n--cut\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), utf8, put("\n--cut\nContent-Type: text/plain\n\nan attachment\n--cut--\n"))
    return F.when(number % 4 == 0, nested).when(number % 4 == 1, latin).when(number % 4 == 2, quoted).otherwise(two)


#: The threads' turns as HTML mails whose quoted part is marked in five ways.
HTML_SQL = """
SELECT conv_id, CASE conv_id % 5
  WHEN 0 THEN concat('<html><body><p>', body, '</p><div class="gmail_quote"><div>', quoted, '</div><p>x</p></div><p>after</p></body></html>')
  WHEN 1 THEN concat('<div>', body, '<!-- a note -->more <b>bold</b></div><blockquote class="a Reply-1"><p>', quoted, '</p></blockquote>')
  WHEN 2 THEN concat('<div>', body, '</div>before<span class="gmail_attr">', quoted, '</span><hr>tail')
  WHEN 3 THEN concat('<div>', body, '<div class="x original-msg"><p>', quoted, '</p><div>deep</div></div>end</div>')
  ELSE concat('<p class="plain">', body, '</p><div class="gmail_extra">', quoted, '</div><p>kind</p>') END AS html
FROM (SELECT conv_id, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body, replace(replace(replace(coalesce(quoted, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS quoted FROM (
  SELECT conv_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS quoted, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS n FROM conversations) t WHERE n = 1) u
"""


def html_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and html."""
    return spark.sql(HTML_SQL.replace("FROM conversations)", "FROM {conversations})"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
