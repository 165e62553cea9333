from siftwell.llm import quotes


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_nested_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "a", "The first message says this.\n\nAnd a second paragraph here."),
        (1, 1, "b", "Ann wrote:\n> The first  message SAYS this.\nI disagree with that one."),
        (1, 2, "c", "an unrelated remark"),
        (1, 3, "a", "> > The first message says this.\n> I disagree with that one.\n\nWhy do you?"),
        (1, 4, "d", "> And a second paragraph here.\nyes indeed it is"),
        (2, 1, "b", "> The first message says this.\nother conversation"),
        (3, 0, "a", None),
        (None, 0, "a", "> The first message says this.\nno conversation"),
        (1, None, "x", "> The first message says this.\nno turn"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(chats(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[1, 1]["parent"] == 0 and got[1, 1]["text"] == "I disagree with that one."
    assert (got[1, 3]["parent"], got[1, 3]["thread"], got[1, 3]["depth"], got[1, 3]["n_quotes"]) == (1, 0, 2, 2)
    assert got[1, 3]["text"] == "Why do you?"
    assert (got[1, 4]["parent"], got[1, 4]["depth"]) == (0, 1)
    assert (got[1, 2]["parent"], got[1, 2]["thread"], got[1, 2]["depth"]) == (None, 2, 0)
    assert got[2, 1]["parent"] is None and got[2, 1]["text"] == "other conversation"
    assert got[3, 0]["text"] == "" and got[None, 0]["parent"] is None and got[1, None]["parent"] is None


def test_long_chain_and_order(spark):
    rows = [(7, t, "u", (f"> message number {t - 1} speaks\n" if t else "") + f"message number {t} speaks") for t in range(40)]
    out = quotes.in_order(quotes.link(chats(spark, rows)), 3).collect()
    assert [r["turn"] for r in out] == list(range(40))
    assert [r["depth"] for r in out] == list(range(40)) and {r["thread"] for r in out} == {0}


def test_empty_table_repeats_and_clashing_columns(spark):
    assert quotes.link(chats(spark, [])).count() == 0
    rows = [(1, 0, "a", "hello there everyone"), (1, 0, "a", "hello there everyone"), (1, 1, "b", "> hello there everyone\nhi")]
    df = chats(spark, rows).selectExpr("*", "1 as units", "2 as root", "'x' as parent")
    out = quotes.link(df)
    assert out.count() == 3 and out.filter("turn = 1").first()["parent"] == 0


def test_sql_gives_the_same_rows(spark):
    import duckdb

    rows = [(1, 0, "a", "The first message says this.\n\nAnd a second paragraph here."), (1, 1, "b", "Ann wrote:\n> The first  message SAYS this.\nI disagree with that one."), (1, 2, "c", " padded\n\n\n\ntext "), (1, 3, "a", "> > The first message says this.\n> I disagree with that one.\n\nWhy do you?"), (1, 4, "d", ">> And a second paragraph here.\r\n>> The first message says this.\nyes"), (2, 0, "x", None), (2, 1, "y", "> only a quotation of nothing"), (None, 0, "z", "no conversation here")]
    df = chats(spark, rows)
    conversations = df.toPandas()  # noqa: F841  DuckDB reads it by name
    want = duckdb.sql(quotes.ORACLE_SQL)
    key = lambda r: str(r)
    names = sorted(want.columns)
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) else x
    theirs = sorted(([plain(r[want.columns.index(c)]) for c in names] for r in want.fetchall()), key=key)
    assert sorted(([plain(r[c]) for c in names] for r in quotes.link(df).collect()), key=key) == theirs


def test_short_messages_are_linked(spark):
    rows = [(1, 0, "a", "I disagree"), (1, 1, "b", "> I disagree\nWhy?"), (1, 2, "a", "> Why?\nno"), (1, 3, "b", ">\n> \nfine"), (2, 0, "a", "好的"), (2, 1, "b", "> 好的\n谢谢"), (2, 2, "c", "a much longer message\nno"), (2, 3, "d", "> a much longer message\n> 谢谢\nso")]
    got = {(r["conv_id"], r["turn"]): (r["parent"], r["thread"], r["depth"]) for r in quotes.link(chats(spark, rows)).collect()}
    assert got[1, 1] == (0, 0, 1) and got[1, 2] == (1, 0, 2) and got[1, 3] == (None, 3, 0)
    assert got[2, 1] == (0, 0, 1) and got[2, 2] == (None, 2, 0) and got[2, 3] == (2, 2, 1)


def test_long_texts_and_control_characters(spark):
    lines = [f"line {i} of a long text" for i in range(20_000)]
    rows = [(1, 0, "a", "\n".join(lines)), (1, 1, "b", "\n".join("> " + x for x in lines) + "\nread it\x01all\x02now"), (1, 2, "c", "> read it all now\nwell")]
    got = {r["turn"]: r for r in quotes.link(chats(spark, rows)).collect()}
    assert (got[1]["parent"], got[1]["n_quotes"], got[1]["text"]) == (0, 1, "read it\x01all\x02now")
    assert (got[2]["parent"], got[2]["depth"]) == (1, 2) and len(got[0]["text"]) == len(rows[0][3])


def test_a_tie_goes_to_the_later_message(spark):
    rows = [(1, 0, "a", "same size a"), (1, 1, "b", "same size b"), (1, 2, "c", "> same size a\n\n> same size b\nboth"), (1, 3, "d", "> same size b\n> same size b\ntwice")]
    got = {r["turn"]: r["parent"] for r in quotes.link(chats(spark, rows)).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: 1}


def test_built_quotations_are_found(spark, tmp_path):
    rows = [(c, t, "u", f"message {t} of talk {c}\nwith a second line") for c in range(3) for t in range(6)]
    chats(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["parent"] for r in quotes.quoted_conversations(spark, str(tmp_path)).collect()}
    assert all([got[c, t] for t in range(6)] == [None, 0, 1, 1, 3, None] for c in range(3))
