"""The eight score axes, in their canonical order."""

# fixed values
AXES = ("personalismo", "institucionalismo", "populismo", "doctrinarismo", "soberanismo", "globalismo", "conservadurismo", "progresismo")
OPPOSITES = tuple(zip(AXES[::2], AXES[1::2]))
