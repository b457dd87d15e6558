"""Column functions over layouts V (values), W (words) and C (containers)."""
