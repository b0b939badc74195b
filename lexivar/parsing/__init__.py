"""A parser for decompiled C: text to rows of facts."""
