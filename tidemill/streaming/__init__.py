"""Streams: folders of files that change, transcripts that grow, and what keeps tables current from them."""
