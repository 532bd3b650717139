"""Clean, grid, fuse and score long-format point observations with Spark."""
