"""Part of quarrylog."""
