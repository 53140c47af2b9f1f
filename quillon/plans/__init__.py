"""Composable query plans over frontiers of nodes, edges and paths."""
