"""Block colours and the palettes made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Block colours, fixed values: name, red, green, blue; the block id is the name in the game namespace unless it is aliased

CONCRETE = """
white 255 255 255
orange 216 127 51
magenta 178 76 216
light_blue 102 153 216
yellow 229 229 51
lime 127 204 25
pink 242 127 165
gray 76 76 76
light_gray 153 153 153
cyan 76 127 153
purple 127 63 178
blue 51 76 178
brown 102 76 51
green 102 127 51
red 153 51 51
black 25 25 25
"""
TERRACOTTA = """
terracotta 152 94 67
white_terracotta 209 178 161
orange_terracotta 161 83 37
magenta_terracotta 149 88 108
light_blue_terracotta 113 108 137
yellow_terracotta 186 133 35
lime_terracotta 103 117 53
pink_terracotta 160 77 78
gray_terracotta 57 42 35
light_gray_terracotta 135 107 98
cyan_terracotta 86 91 91
purple_terracotta 118 70 86
blue_terracotta 74 59 91
brown_terracotta 77 51 35
green_terracotta 76 83 42
red_terracotta 143 61 47
black_terracotta 37 22 16
"""
FROGLIGHT = """
sea_lantern 172 217 203
glowstone 175 133 74
shroomlight 246 172 119
pearlescent_froglight 240 215 220
verdant_froglight 210 230 200
ochre_froglight 245 225 160
"""
WOOL = """
white_wool 233 236 236
orange_wool 240 118 19
magenta_wool 189 68 179
light_blue_wool 58 175 217
yellow_wool 248 197 39
lime_wool 112 185 25
pink_wool 237 141 172
gray_wool 62 68 71
light_gray_wool 142 142 134
cyan_wool 21 137 145
purple_wool 121 42 172
blue_wool 53 57 157
brown_wool 114 71 40
green_wool 84 109 27
red_wool 160 39 34
black_wool 20 21 25
"""
SPECIAL_BLOCKS = """
gold_block 246 208 61
iron_block 220 220 220
diamond_block 98 237 228
emerald_block 43 201 93
lapis_block 30 67 140
quartz_block 235 229 222
obsidian 15 11 24
coal_block 18 18 18
"""
CONCRETE_POWDER = """
white_concrete_powder 226 227 227
orange_concrete_powder 227 131 31
magenta_concrete_powder 193 84 185
light_blue_concrete_powder 74 181 213
yellow_concrete_powder 233 199 55
lime_concrete_powder 126 189 41
pink_concrete_powder 229 153 181
gray_concrete_powder 76 81 84
light_gray_concrete_powder 154 154 148
cyan_concrete_powder 36 147 156
purple_concrete_powder 132 56 178
blue_concrete_powder 70 73 166
brown_concrete_powder 126 85 54
green_concrete_powder 97 119 44
red_concrete_powder 168 54 50
black_concrete_powder 26 27 32
"""
WOOD_PLANKS = """
oak_planks 162 130 78
spruce_planks 114 84 48
birch_planks 192 175 121
jungle_planks 160 115 80
acacia_planks 168 90 50
dark_oak_planks 66 43 20
mangrove_planks 118 51 51
cherry_planks 226 178 174
bamboo_planks 196 172 70
crimson_planks 106 50 70
warped_planks 43 104 99
"""
STONE_MINERALS = """
stone 125 125 125
granite 149 103 85
diorite 188 188 188
andesite 134 134 134
deepslate 81 81 84
tuff 108 109 102
calcite 224 223 218
dripstone_block 134 107 92
basalt 80 80 85
blackstone 42 38 45
netherrack 111 54 54
end_stone 220 223 158
purpur_block 169 125 169
prismarine 99 156 151
prismarine_bricks 99 171 158
dark_prismarine 51 91 75
clay 160 166 179
mud 60 57 62
snow_block 240 249 249
packed_ice 160 196 245
blue_ice 116 167 253
sponge 195 195 80
"""

NAMESPACE = "minecraft:"
# Block ids that differ from the name of a colour, fixed values
CONCRETE_BLOCKS = "concrete"  # the 16 plain colours are this material
ALIASES = {"terracotta": "hardened_clay"}  # asked for, resolved to
FALLBACK = "dirt"  # for ids that don't resolve


def _rows(*tables: str, start: int = 0) -> list[tuple[int, str, str, int, int, int]]:
    """(color, name, block, r, g, b) of the tables in order; color counts up from start."""
    out = []
    for table in tables:
        for line in table.strip().splitlines():
            name, r, g, b = line.split()
            block = f"{name}_{CONCRETE_BLOCKS}" if table is CONCRETE else ALIASES.get(name, name)
            out.append((start + len(out), name, NAMESPACE + block, int(r), int(g), int(b)))
    return out


FAMILIES = (CONCRETE, TERRACOTTA, FROGLIGHT, WOOL, SPECIAL_BLOCKS, CONCRETE_POWDER, WOOD_PLANKS, STONE_MINERALS)
PALETTES = {"concrete": _rows(*FAMILIES[:1]), "expanded": _rows(*FAMILIES[:2]), "full": _rows(*FAMILIES[:3]), "all": _rows(*FAMILIES[:5]), "ultra": _rows(*FAMILIES)}
SCHEMA = "palette string, color int, name string, block string, r int, g int, b int"


def palette_rows(name: str) -> list[tuple[int, str, str, int, int, int]]:
    """The entries of a palette; an unknown name is a KeyError."""
    return PALETTES[name]


def palette(spark: SparkSession, *names: str) -> DataFrame:
    """The named palettes, all without a name, as rows: at most a few hundred, fit to be broadcast."""
    rows = [(p, *entry) for p in (names or PALETTES) for entry in palette_rows(p)]
    return spark.createDataFrame(rows, SCHEMA)


def values_sql(*names: str) -> str:
    """The same rows as a VALUES list."""
    return ", ".join("('{}', {}, '{}', '{}', {}, {}, {})".format(p, *entry) for p in (names or PALETTES) for entry in palette_rows(p))
