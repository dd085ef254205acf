"""Texts for a model: what an agent is told about files to take in, and the context of a question.

The wording is this engine's own; what a text has to tell is the files with their parts, targets and images, the
structure of the knowledge base, the rules of writing, and for a question the best concepts and the index page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = "## Image outcomes"

WRITING = f"""You maintain a knowledge base of concept pages below wiki/. Turn the input files below into concept pages.
- Read every file first. Read the extracted text where one is listed, all parts of it; read the original otherwise.
- Files about one thing become one page. Reuse the id of an existing page about it; a new page goes into a directory.
- A page begins with front matter: type, title, description, tags, generated (by, at) and sources, one for each file,
  whose resource is /archive/ and the file's path below input/. Then Markdown, with claims that name their source.
- Where sources disagree, show all values with their sources and dates, and say which holds if one is clearly newer.
- Only when the page is written, move each original to the archive path listed for it; never overwrite a file.
- What can't be used stays in input/. Report it, and what couldn't be read, at the end.
- Read image findings instead of images. For each image listed as not analysed, add a line under "{OUTCOMES}":
  - <path> <image id>: content|decorative|unreadable - <note>"""

ANSWERING = """Answer from the knowledge base in wiki/ only, in the language of the question.
- Link the page of every claim as [title](wiki/<id>.md) and list all pages used under "# Sources".
- Read whole pages. Where values disagree, give the one that holds and say that others exist; if none does, give all.
- Prefer pages reviewed by people and newer ones; say so where a page is unverified, deprecated or past stale_after.
- Follow links to related and newer pages. If the answer isn't there, say so."""


def file_entries(files: DataFrame, images: DataFrame, most: int | None = 24) -> DataFrame:
    """(relative_path, entry): a block of lines about each file (relative_path, source_format, target, texts, findings, warnings) and its images (doc, id, status, occurrences, path).

    Of the images that await the agent ``most`` are listed, all with None.
    """
    number = F.struct(F.char_length("id").alias("n"), "id")
    place = lambda o: F.concat(F.coalesce(F.concat(F.lit(" — "), o["location"]), F.lit("")), F.coalesce(F.concat(F.lit("; near: "), o["context"]), F.lit("")))
    line = F.concat(F.lit("    - "), "id", F.lit(": "), F.coalesce("path", F.lit("")), F.coalesce(place(F.try_element_at("occurrences", F.lit(1))), F.lit("")))
    waits = F.col("status").isin("staged", "failed")
    per = images.groupBy(F.col("doc").alias("relative_path")).agg(F.count("*").alias("n"), F.sum(F.size("occurrences")).alias("o"), F.sort_array(F.collect_list(F.when(waits, F.struct(number.alias("k"), line.alias("l"))))).alias("open"))
    shown = F.col("open") if most is None else F.slice("open", 1, most)
    asked = F.when(F.size("open") > 0, F.concat(F.lit(f'  Images not analysed, to be reported under "{OUTCOMES}":\n'), F.array_join(F.transform(shown, lambda x: x["l"]), "\n")))
    texts = F.when(F.size("texts") > 0, F.concat(F.lit("  Extracted text, "), F.size("texts").cast("string"), F.lit(" part(s): "), F.array_join("texts", ", ")))
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("- input/"), "relative_path", F.coalesce(F.concat(F.lit(" ("), "source_format", F.lit(")")), F.lit("")), F.lit(" -> "), "target"),
        texts,
        F.when(F.col("n").isNotNull(), F.concat(F.lit("  Images: "), F.col("n").cast("string"), F.lit(" unique, "), F.col("o").cast("string"), F.lit(" occurrence(s)"))),
        F.concat(F.lit("  Image findings: "), "findings"),
        asked,
        F.when(F.size("warnings") > 0, F.concat(F.lit("  Limits of the extraction, for the log: "), F.array_join("warnings", "; "))),
    )
    return files.join(per, "relative_path", "left").select("relative_path", entry.alias("entry"))


def update_prompt(entries: list[str], structure: list[tuple[str, str, int | None]]) -> str:
    """What the agent is told; one text, so its entries are those of one turn."""
    named = lambda part: ", ".join(n if k is None else f"{n} ({k})" for p, n, k in structure if p == part) or "(none yet)"
    return f"{WRITING}\n\nDirectories: {named('directory')}\nTypes in use: {named('type')}\nExisting ids: {named('concept')}\n\nInput files:\n" + "\n".join(entries)


def query_context(retrieved: list[tuple[str, str]], index: str | None) -> str:
    """The context of a question: rules, the best concepts (id, content) and the index page."""
    found = "\n\n".join(f"--- {c} ---\n{content}" for c, content in retrieved) or "(no page shares a word with the question; look for yourself)"
    return f"{ANSWERING}\n\n## Index\n\n{index or '(no index page)'}\n\n## Pages\n\n{found}"


def query_prompt(question: str, context: str) -> str:
    return f"{context}\n\n## Question\n\n{question}"
