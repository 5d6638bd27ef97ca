"""Texts that operators must not trip over."""

ODD_TEXTS = [
    "one text", "One TEXT", "one text", "", None, "   ", "\n\n", "é " * 5, "É " * 5, "x" * 70_000,
    "word " * 30_000, "a\nb\nb\n\nb", "ends with space ", "tab\tand\x0bothers\x0c\r\n", "ſtrange K", "\x00null",
]
