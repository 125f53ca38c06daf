"""The dialect's four types: their literals, values and text."""
