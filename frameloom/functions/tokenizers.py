"""Tokenizers of grids: columns of cells to columns of tokens, and back."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, functions as F

from frameloom.functions import frames as X


class Tokenizer(ABC):
    """Tokens run from 0 to vocabulary - 1; the last two begin and end a frame."""

    vocabulary: int

    @abstractmethod
    def encode(self, state: Column) -> Column:
        """The tokens of a frame, between start and end."""

    @abstractmethod
    def decode(self, tokens: Column) -> Column:
        """The cells of encode's tokens."""

    def pair(self, states: Column) -> tuple[Column, Column]:
        """Input and target of frames in a row: start and end tokens do not count, nor do the first frame's, which is given."""
        frames = F.transform(states, self.encode)
        quiet = lambda t: F.transform(t, lambda x: F.when(x >= self.vocabulary - 2, F.lit(-100).cast("bigint")).otherwise(x))
        given = F.transform(frames, lambda t, i: F.when(i == 0, F.transform(t, lambda x: F.lit(-100).cast("bigint"))).otherwise(quiet(t)))
        return F.flatten(frames), F.flatten(given)


class PatchTokenizer(Tokenizer):
    """A token for each patch x patch cells of a rows x cols grid."""

    def __init__(self, patch: int, rows: int, cols: int, colours: int = 10):
        self.patch, self.rows, self.cols, self.colours = patch, rows, cols, colours
        self.vocabulary = colours ** (patch * patch) + 2

    def encode(self, state: Column) -> Column:
        return X.patch_tokens(state, self.patch, self.rows, self.cols, self.colours)

    def decode(self, tokens: Column) -> Column:
        return X.patch_cells(tokens, self.patch, self.rows, self.cols, self.colours)


class FlatTokenizer(Tokenizer):
    """A token for each cell, moved by the offset of its vocabulary."""

    def __init__(self, colours: int, offset: int = 0):
        self.colours, self.offset, self.vocabulary = colours, offset, offset + colours + 2

    def encode(self, state: Column) -> Column:
        return X.offset_tokens(state, self.offset, self.offset + self.colours, self.offset + self.colours + 1)

    def decode(self, tokens: Column) -> Column:
        return F.transform(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0))), lambda t: t - self.offset)
