"""Readers: capture files to packets, packets to messages, text to lines."""
