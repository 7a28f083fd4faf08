"""Readers and writers: feeds, search results, manifests, lists, HTML tables, exports."""
