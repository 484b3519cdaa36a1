"""Column functions over text: cleaning, classification, names, keys, language."""
