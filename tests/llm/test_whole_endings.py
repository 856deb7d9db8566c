"""Endings are judged on the whole last paragraph, after all trailers."""

from panelmill.llm.truncation import cut_texts


def test_long_last_paragraphs_and_many_trailers(spark):
    filler = "and so it goes on, word by word, " * 80
    trailers = [f"-- sent by list {c}" for c in "ABCD"]
    docs = [(f"{c}{k}", "Some text. " * (3 * k + 7 * i + 1) + "It ends here.\n\n" + c) for i, c in enumerate(trailers) for k in range(3)]
    docs += [
        ("open", "It begins.\n\nThe last\\footnote{Here " + filler + "and it ends."),
        ("closed", "It begins.\n\nThe last $x + " + filler + " y$ and it ends."),
        ("trailers", "All is said.\n\n" + "\n\n".join(trailers)),
        ("cut", "All is said, but \n\n" + "\n\n".join(trailers)),
    ]
    df = spark.createDataFrame([(k, t, "s") for k, t in docs], "doc string, t string, src string")
    got = {r["doc"] for r in cut_texts(df, "doc", "t", "src").collect() if r["cut"]}
    assert got == {"open", "cut"}
