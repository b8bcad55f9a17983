"""Keelson: keyed collections, message passing, graph, text and learning operators as DataFrame plans."""
