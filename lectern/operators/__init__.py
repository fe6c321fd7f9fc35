"""Operators over tables of blocks, sections, utterances, segments and catalogue records."""
