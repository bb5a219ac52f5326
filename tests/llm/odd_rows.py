"""Rows that every operator has to answer."""

#: Nulls, empty and blank texts, ties, repeated rows, a long text, rare characters.
ODD = ((1, None), (2, ""), (3, " \n\t "), (4, "Password: abc DEF"), (5, "password: ABC def"), (5, "password: ABC def"), (6, "word " * 30_000),
       (None, "no id here"), (None, None), (7, "日本語 ▁x é́ \U0010ffff\x1c\x0b a  b\n\n c"), (8, "<|endoftext|> don't 'S"), (9, "İSTANBUL Σ, ſ K."))
